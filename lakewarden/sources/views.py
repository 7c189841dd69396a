"""Views that the queries run on, derived from the given tables, each in Spark and as DuckDB SQL.

The library's operators take any DataFrames; these views only give them columns of the shapes they expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDERS = ("openai", "anthropic", "gemini")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gateway request per event."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    error = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 12).cast("string")).alias("tenant_id"), F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("event_id") % 3 + 1).cast("int")).alias("provider"),
        F.concat(F.lit("m"), (F.col("k") % 5).cast("string")).alias("model"), F.col("event_type").alias("endpoint"), F.when(error, "5xx").otherwise("2xx").alias("status_class"),
        F.when(error, "upstream_error").otherwise("complete").alias("outcome"), (F.col("value") * 10).alias("latency_ms"), F.least(F.col("value") / 200, F.lit(1.0)).alias("waf_score"),
        (F.least(F.col("value") / 200, F.lit(1.0)) < 0.8).alias("allowed"), F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), F.col("k").cast("long").alias("output_tokens"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests delivered at least once: every seventh comes again a minute later."""
    r = requests(spark, sf_dir)
    return r.unionByName(r.filter("request_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 minute")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations")
    score = (F.char_length("text") % 10) / 10
    return t.select(F.col("conv_id").alias("session_id"), "turn", "role", "text", score.alias("score"), (score < 0.9).alias("allowed"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("tenant"), F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 40) * 60).alias("ts"), "text", "lang")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain per user: node_id covers the event, prev_hash is the predecessor's."""
    from pyspark.sql.window import Window

    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("node_id", event_hash())
    return e.select(F.col("user_id").alias("chain_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", "micros", "value", "node_id", F.coalesce(F.lag("node_id").over(w), F.lit("0" * 64)).alias("prev_hash"))


def event_hash():
    return F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("micros").cast("string"), F.floor(F.col("value") * 1000000).cast("long").cast("string")), 256)


def chain_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with changed values, missing rows and rows that claim their predecessor's predecessor."""
    from pyspark.sql.window import Window

    c = chain(spark, sf_dir)
    again = F.lag("prev_hash").over(Window.partitionBy("chain_id").orderBy("seq"))
    c = c.withColumn("prev_hash", F.when(F.col("event_id") % 1999 == 0, F.coalesce(again, "prev_hash")).otherwise(F.col("prev_hash")))
    return c.withColumn("value", F.when(F.col("event_id") % 997 == 0, F.col("value") + 1).otherwise(F.col("value"))).filter("event_id % 1499 <> 0")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a Merkle log per tenant: tenant_id, idx (from 0), leaf_hash."""
    from pyspark.sql.window import Window

    e = load(spark, sf_dir, "events").withColumn("tenant_id", F.concat(F.lit("t"), (F.col("user_id") % 12).cast("string")))
    w = Window.partitionBy("tenant_id").orderBy("event_id")
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.floor(F.col("value") * 1000000).cast("long").cast("string")), 256)
    return e.select("tenant_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), digest.alias("leaf_hash"))


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of a log: a has event_id % 3 in (0, 2), b in (1, 2); b holds another digest where event_id % 101 = 2."""
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("state_id"), "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    digest = lambda salt: F.sha2(F.concat_ws("|", "state_id", F.col("micros").cast("string"), salt), 256)
    a = e.filter("event_id % 3 in (0, 2)").withColumn("digest", digest(F.lit("")))
    b = e.filter("event_id % 3 in (1, 2)").withColumn("digest", digest(F.when(F.col("event_id") % 101 == 2, "x").otherwise("")))
    return a, b


#: DuckDB forms of the views, as CTEs.
SQL = {
    "requests": """requests AS (SELECT event_id AS request_id, ts, 's' || user_id AS session_id, 't' || (user_id % 12) AS tenant_id, ['openai', 'anthropic', 'gemini'][(event_id % 3 + 1)::INT] AS provider,
  'm' || (k % 5) AS model, event_type AS endpoint, CASE WHEN event_type = 'error' THEN '5xx' ELSE '2xx' END AS status_class, CASE WHEN event_type = 'error' THEN 'upstream_error' ELSE 'complete' END AS outcome,
  value * 10 AS latency_ms, least(value / 200, 1.0) AS waf_score, least(value / 200, 1.0) < 0.8 AS allowed, floor(value * 10)::BIGINT AS input_tokens, k::BIGINT AS output_tokens
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))""",
    "deliveries": "deliveries AS (SELECT * FROM requests UNION ALL SELECT * REPLACE (ts + INTERVAL 1 MINUTE AS ts) FROM requests WHERE request_id % 7 = 0)",
    "turns": "turns AS (SELECT conv_id AS session_id, turn, role, text, (length(text) % 10) / 10 AS score, (length(text) % 10) / 10 < 0.9 AS allowed FROM conversations)",
    "texts": "texts AS (SELECT doc_id AS id, source AS tenant, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 40) AS ts, text, lang FROM documents)",
    "chain": """chain AS (SELECT *, coalesce(lag(node_id) OVER (PARTITION BY chain_id ORDER BY seq), repeat('0', 64)) AS prev_hash FROM (
  SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id, epoch_us(ts) AS micros, value, sha256(event_id || '|' || epoch_us(ts) || '|' || floor(value * 1000000)::BIGINT) AS node_id FROM events))""",
    "tampered": """tampered AS (SELECT chain_id, seq, event_id, micros, CASE WHEN event_id % 997 = 0 THEN value + 1 ELSE value END AS value, node_id,
  CASE WHEN event_id % 1999 = 0 THEN coalesce(lag(prev_hash) OVER (PARTITION BY chain_id ORDER BY seq), prev_hash) ELSE prev_hash END AS prev_hash FROM chain QUALIFY event_id % 1499 <> 0)""",
    "leaves": "leaves AS (SELECT 't' || (user_id % 12) AS tenant_id, row_number() OVER (PARTITION BY 't' || (user_id % 12) ORDER BY event_id) - 1 AS idx, sha256(event_id || '|' || floor(value * 1000000)::BIGINT) AS leaf_hash FROM events)",
    "replicas": """ra AS (SELECT 'e' || event_id AS state_id, event_id, user_id, epoch_us(ts) AS micros, sha256('e' || event_id || '|' || epoch_us(ts) || '|') AS digest FROM events WHERE event_id % 3 IN (0, 2)),
rb AS (SELECT 'e' || event_id AS state_id, event_id, user_id, epoch_us(ts) AS micros, sha256('e' || event_id || '|' || epoch_us(ts) || '|' || CASE WHEN event_id % 101 = 2 THEN 'x' ELSE '' END) AS digest FROM events WHERE event_id % 3 IN (1, 2))""",
}


def with_views(names: str, body: str) -> str:
    """body after the views' CTEs; a WITH at its start goes on with its own."""
    views = ",\n".join(SQL[n] for n in names.split())
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{views},\n{body[len(start) :]}"
    return f"WITH {views}\n{body}"
