"""Exact top-k search by integer inner product with a three-phase uniform threshold.

The dimensions are cut into `lists` slices; the scores of a slice are one list, and a score is the sum over lists.
1. Each task gathers, for its block of rows, the best k of one list (another list from block to block) for each query and
   completes their scores; the k-th best completed score of a query over all tasks is a safe cutoff: no smaller
   score can be in its top k.
2. The cutoffs are sent out. A task goes through the lists one after another and drops a row for a query as soon as what is left
   of the row (the product of the lengths of the slices to come bounds it) can't lift it to the cutoff. Once few are left,
   the other lists are computed for these alone. A row is collected if one list's score reaches cutoff / lists.
3. Collected rows are completed exactly; those at the cutoff or above go on, and the best k are kept.

Rows are packed into blocks of fixed size, and queries into groups of fixed size; every row block meets every query group once a
phase, so memory is bounded whatever the tables' size, and the work is queries times rows at most, as an exact search over
a query set asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, partitions, stored, table

QUERY_GROUP, ROW_BLOCK = 16_384, 4096
STEP = 256  # queries of a group that a task scores at once
LISTS = 4
FEW = 0.2  # share of rows left from which the lists to come are computed for these alone
SENT = 2_000_000  # components of all queries together, up to which they are broadcast: 16 MB


def _packed(df: DataFrame, size: int, salt: str) -> DataFrame:
    """(dim, block, ids, data): blocks of about `size` vectors of one dimension, as int64 arrays."""
    n = df.groupBy("dim").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / size))
    blocks = df.join(n.select("dim", "blocks"), "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "id"), F.col("blocks")))
    return blocks.groupBy("dim", "block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("data"))


def _slices(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(LISTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of vectors too long for exact float64 sums. Beyond int64, saturated."""
    big = q.astype(object) @ c.astype(object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def _safe(q: np.ndarray, c: np.ndarray) -> bool:
    return not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53


def _first(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query i, ties to smaller ids."""
    order = np.lexsort((ids, -score, i))
    place = np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left")
    return order[place < k]


def gather(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query ids, scores): completed scores of the best k rows of list `at` for each query."""
    if not _safe(q, c):
        score = _whole(q, c).astype(np.float64)
        i, j = np.nonzero(qids[:, None] != ids[None, :])
        full = score[i, j]
    else:
        q, c = q.astype(np.float64), c.astype(np.float64)
        cut = _slices(q.shape[1])[at % len(_slices(q.shape[1]))]
        part = q[:, cut] @ c[:, cut].T
        most = min(k + 1, len(ids))
        j = np.argpartition(-part, most - 1, axis=1)[:, :most].ravel()
        i = np.repeat(np.arange(len(q)), most)
        other = qids[i] != ids[j]
        i, j = i[other], j[other]
        full = np.einsum("ij,ij->i", q[i], c[j])
    top = _first(i, ids[j], full, k)
    return qids[i[top]], full[top].astype(np.int64)


def resolve(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, cutoffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query ids, row ids, scores) at the cutoffs or above, k for a query at most, and how many
    pairs were completed. A cutoff is -inf where there is none."""
    if not _safe(q, c):
        i, j = np.nonzero(qids[:, None] != ids[None, :])
        score = _whole(q, c)[i, j]
        top = _first(i, ids[j], score, k)
        return qids[i[top]], ids[j[top]], score[top], len(i)
    q, c, slices = q.astype(np.float64), c.astype(np.float64), _slices(q.shape[1])
    lengths = lambda x: np.stack([np.sqrt((x[:, s] ** 2).sum(axis=1)) for s in slices])
    ql, cl = lengths(q), lengths(c)
    share = cutoffs / len(slices)
    left = qids[:, None] != ids[None, :]
    part, collected = np.zeros(left.shape), np.zeros(left.shape, bool)
    for n, s in enumerate(slices):
        one = q[:, s] @ c[:, s].T
        part += one
        collected |= one >= share[:, None]
        left &= part + ql[n + 1 :].T @ cl[n + 1 :] >= cutoffs[:, None] - 0.5  # scores are whole numbers
        if left.mean() <= FEW:
            break
    i, j = np.nonzero(left)
    score, some = part[i, j], collected[i, j]
    for s in slices[n + 1 :]:
        one = np.einsum("ij,ij->i", q[i, s], c[j, s])
        score += one
        some |= one >= share[i]
    fine = some & (score >= cutoffs[i])
    i, j, score = i[fine], j[fine], score[fine]
    top = _first(i, ids[j], score, k)
    return qids[i[top]], ids[j[top]], score[top].astype(np.int64), int(left.sum())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, query ids, queries, row ids, rows, cutoffs by query) of each cell, STEP queries at once."""
    for batch in batches:
        for row in range(batch.num_rows):
            x = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
            dim = x["dim"].as_py()
            of = lambda name: x[name].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            qids, q, ids, c = of("qids"), of("q").reshape(-1, dim), of("ids"), of("c").reshape(-1, dim)
            cutoffs = dict(zip(of("cq").tolist(), of("cs").tolist(), strict=True)) if "cq" in x else {}
            for a in range(0, len(qids), STEP):
                some = slice(a, a + STEP)
                yield x["block"].as_py(), qids[some], q[some], ids, c, np.array([cutoffs.get(i, -np.inf) for i in qids[some].tolist()])


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, qids, q, ids, c, _ in _cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in gather(qids, q, ids, c, k, block)], ["query_id", "score"])

    return run


def _resolve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, qids, q, ids, c, cutoffs in _cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in resolve(qids, q, ids, c, cutoffs, k)[:3]], ["query_id", "vec_id", "score"])

    return run


def exact_topk(df: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k highest inner products of every query row with the other rows of df.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id and score, ties to the smaller vec_id.
    Vectors that are null, empty, of another dimension than the query's, or hold null or non-finite
    components take no part, nor do rows without an id. Of rows with one id each is a candidate of its own, but
    none of a query with that id; of query rows with one id the smallest vector asks. Fewer candidates than k: all of them. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    v = F.transform(named(df, vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall(named(df, vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.filter(fine & named(df, id_col).isNotNull() & (F.size(named(df, vector_col)) > 0)).select(named(df, id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.withColumn("dim", F.size("v"))
    blocks = stored(_packed(rows.select("id", "v", "dim"), ROW_BLOCK, "r").withColumnRenamed("data", "c"), "row-blocks")
    queries = rows.filter("asked").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = stored(_packed(queries, QUERY_GROUP, "q").select("dim", F.col("block").alias("group"), F.col("ids").alias("qids"), F.col("data").alias("q")), "query-groups")
    cells = blocks.select("dim", "block").join(asked.select("dim", "group"), "dim").count()
    sent = F.broadcast if (asked.agg(F.sum(F.size("q"))).first()[0] or 0) <= SENT else lambda x: x

    def met(groups: DataFrame) -> DataFrame:
        """Every row block with every query group of its dimension."""
        return blocks.join(sent(groups), "dim").repartition(max(1, min(cells, 16 * partitions(spark))))

    first = met(asked).select("dim", "block", "qids", "q", "ids", "c").mapInArrow(_gather(k), "query_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    safe = stored(first.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k).select("query_id", "score"), "cutoffs")
    cutoffs = asked.select("dim", "group", F.explode("qids").alias("query_id")).join(safe, "query_id").groupBy("dim", "group").agg(F.collect_list("query_id").alias("cq"), F.collect_list("score").alias("cs"))
    none = F.array().cast("array<long>")
    groups = asked.join(cutoffs, ["dim", "group"], "left").withColumns({c: F.coalesce(c, none) for c in ("cq", "cs")})
    last = met(groups).select("dim", "block", "qids", "q", "ids", "c", "cq", "cs").mapInArrow(_resolve(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return last.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best for every vector whose vec_id is divisible by 20, among all others."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
