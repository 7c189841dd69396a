"""Mixing sources to target weights by weighted fair queueing (native: DataFrame functions only).

Every source is a flow whose documents wait in seeded-shuffled order, the whole queue `max_epochs` times. A
document's virtual finish time is the source's words up to and with it, divided by the source's target
weight. Served in the order of finish times, sources advance in proportion to their weights; the order is
range-sorted and cut at the word budget. Prefix sums are two-level, so a hot source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORD, named, range_dealt, running, shuffle_key, stored, table

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Water-filling over the table of sources (source, source_size): share * all words are dealt by weight,
    a source stops at cap * its size, the excess goes to the others by weight.

    With sources in the order of cap*size/weight, those that stop come first; the level of the rest
    follows from running sums. One row per source, so the windows are over a dimension table.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast("long"))
    t = t.withColumn("_full", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_budget", F.lit(share) * F.sum("source_size").over(everything)).withColumn("_all_w", F.sum("_w").over(everything))
    t = t.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    # the level of the first source that does not stop is the level of all that don't
    level = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_level"))).over(everything)["_level"]
    t = t.withColumn("_level", level)
    stops = F.col("_level").isNull() | (F.col("_full") <= F.col("_level"))
    return t.select("source", "source_size", F.when(stops, F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_level")).alias("target"), F.col("_budget").alias("budget"))


def fair_mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 23, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size, source_size, target, copies (0..max_epochs), taken (copies * size) and the
    columns named in keep (not doc_id or source again), one row for each input row. Null or blank text: size 0, never taken. Null source:
    a source of its own, last. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    slim = df.select(
        *[named(df, k).alias(f"_keep{i}") for i, k in enumerate(keep or [])], named(df, id_col).alias("doc_id"), named(df, source_col).alias("source"), word_count(named(df, text_col)).alias("size"),
        F.md5(F.coalesce(named(df, text_col), F.lit("")).cast("binary")).alias("_md5"), F.monotonically_increasing_id().alias("_rid"),
    )
    slim = slim.withColumn("_null", F.col("source").isNull()).withColumn("_h", shuffle_key(seed, F.col("doc_id"), F.col("_md5"))).drop("_md5")
    slim = stored(slim, "mix-sizes")  # words are counted once
    queue = ["_null", "source", "_h", "doc_id", "_rid"]
    dealt = range_dealt(slim, queue, "mix-queue")
    targets = source_targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    targets = stored(targets, "mix-targets")
    flow = running(dealt, queue, F.col("size"), "_done", ["_null", "source"]).drop("_pid")
    flow = flow.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    flow = stored(flow, "mix-flow")
    finish = lambda copy: (F.col("_done") + copy * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
    order = ["_finish", "_null", "source", "_h", "doc_id", "_rid"]
    served = flow.filter("size > 0").withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(max_epochs)])))
    served = served.withColumn("_finish", finish(F.col("_copy"))).filter("_finish is not null").select(*order, "size", "budget")
    served = running(range_dealt(served, order, "mix-order"), order, F.col("size"), "_clock")
    place = lambda at: F.struct(at.alias("_finish"), *[F.col(c) for c in order[1:]])
    last = served.filter("_clock <= budget").agg(F.max(place(F.col("_finish"))).alias("_last"))  # one row: where the budget ends
    copies = F.lit(0)
    for i in range(max_epochs):
        copies = copies + F.coalesce((place(finish(F.lit(i))) <= F.col("_last")) & (F.col("size") > 0) & (F.col("target") > 0), F.lit(False)).cast("int")
    out = flow.join(F.broadcast(last)).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep or [])])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('23:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS lev FROM f
  WINDOW o AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(lev, full_at) AS level FROM l WHERE full_at > lev),
t AS (SELECT source, source_size, budget, CASE WHEN level IS NULL OR full_at <= level THEN cap::DOUBLE ELSE w * level END AS target FROM l, v),
q AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, rid ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, (done + e * source_size) / target AS finish FROM q, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
k AS (SELECT rid, size, budget, sum(size) OVER (ORDER BY finish, source IS NULL, source, h, doc_id, rid ROWS UNBOUNDED PRECEDING) AS clock FROM c),
n AS (SELECT rid, count(*) AS copies FROM k WHERE clock <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken FROM q LEFT JOIN n USING (rid)
"""
