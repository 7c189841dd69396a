"""Sharding by proportional stratified interleaving (native: DataFrame functions only).

The rows of each source are shuffled by a seeded hash and ranked; row r of a source of n rows gets the
fractional rank (2r-1)/2n. In the order of fractional ranks every stretch of rows holds the sources in the
proportions of the whole, so cutting it into runs of equal length gives shards that all match the mixture.
Both ranks are two-level prefix sums over range partitions: a source with a third of all rows is spread
over many tasks.

Law: `rows` - row counts of shards are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, range_dealt, running, shuffle_key, table


def stratified_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 24, seed: int = 17) -> DataFrame:
    """Assign every row of df to a shard and a slot in it.

    Returns doc_id, source, size (UTF-8 bytes + 8), text_crc32, shard (0..shards-1) and slot (gapless from 0
    in each shard), one row for each input row. Null text: size 8, crc of the empty text. Null source: a
    source of its own. Repeated rows each get a slot. Fewer rows than shards: some shards stay empty. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(named(df, text_col), F.lit(""))
    slim = df.select(
        named(df, id_col).alias("doc_id"), named(df, source_col).alias("source"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_h", shuffle_key(seed, F.col("doc_id"), F.col("text_crc32")))
    slim = slim.withColumn("_null", F.col("source").isNull())
    order = ["_null", "source", "_h", "doc_id", "text_crc32"]
    ranked = running(range_dealt(slim, order, "shard-ranks"), order, F.lit(1), "_rank", ["_null", "source"])
    sizes = slim.groupBy(F.col("_null").alias("_n"), F.col("source").alias("_s")).agg(F.count("*").alias("_rows"))
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_frac", (2 * F.col("_rank") - 1) / (2 * F.col("_rows"))).drop("_pid", "_n", "_s", "_rows", "_rank")
    order = ["_frac", *order]
    placed = running(range_dealt(ranked, order, "shard-order"), order, F.lit(1), "_pos")
    total = placed.sparkSession.range(1).select(F.lit(0).alias("_zero")).join(slim.agg(F.count("*").alias("_total")))
    pos, base, more = F.col("_pos") - 1, F.expr(f"_total div {shards}"), F.col("_total") % shards
    long_part = more * (base + 1)
    shard = F.when(pos < long_part, F.floor(pos / (base + 1))).otherwise(more + F.floor((pos - long_part) / F.greatest(base, F.lit(1))))
    start = F.col("shard") * base + F.least(F.col("shard"), more)
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (pos - start).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `rows`; grown_shard is null under this law."""
    out = stratified_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its table of 256 values, computed by rule; then the same ranks.
SQL = """
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS tab),
u AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, text, strlen(text)::BIGINT + 8 AS size, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM u),
k AS MATERIALIZED (SELECT doc_id, source, size, xor(list_reduce(bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32 FROM b, t),
h AS (SELECT *, ('0x' || substr(md5('17:' || doc_id || ':' || text_crc32), 1, 15))::BIGINT AS h FROM k),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS frac FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source IS NULL, source, h, doc_id, text_crc32) - 1 AS pos, count(*) OVER () // 24 AS base, count(*) OVER () % 24 AS more FROM r),
s AS (SELECT *, CASE WHEN pos < more * (base + 1) THEN pos // (base + 1) ELSE more + (pos - more * (base + 1)) // greatest(base, 1) END AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (pos - shard * base - least(shard, more))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
