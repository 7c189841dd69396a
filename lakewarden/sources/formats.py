"""Formats of audit logs: JSON lines with damaged ones apart, segment manifests, SIEM lines, STIX bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators.search import dense_position


def read_jsonl(spark: SparkSession, path: str, schema: str, defaults: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, counts) of a folder of JSON lines. rows: the schema's columns, defaults where null, and file; quarantine:
    file, line, reason of lines that are no JSON objects; counts: lines and bad ones of each file. Blank lines count for nothing."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("line"))
    parsed = lines.withColumn("_r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    rows = parsed.filter(~bad).select("_r.*", "file").drop("_bad")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    reason = F.when(F.trim("line").startswith("{"), "no JSON").otherwise("no object")
    return rows, parsed.filter(bad).select("file", "line", reason.alias("reason")), parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"))


def segment_manifest(spark: SparkSession, path: str, schema: str, order: list[str], node: str, stored) -> DataFrame:
    """segment, size, file_sha256, leaf_count, chain_tip and mmr_root of each file of JSON lines; segments are closed at a bounded
    size, so a file's bytes are one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.element_at(F.split("path", "/"), -1).alias("segment"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_sha256"))
    rows = spark.read.schema(schema).json(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("segment"), *order, node)
    placed = dense_position(rows, ["segment", *order], stored, 16)
    first = placed.groupBy("segment").agg(F.min("position").alias("_first"), F.count("*").alias("n"), F.max_by(node, "position").alias("chain_tip"))
    leaves = stored(placed.join(first, "segment").select("segment", (F.col("position") - F.col("_first")).alias("idx"), F.col(node).alias("leaf_hash")))
    first = stored(first.drop("_first"))
    roots = I.mmr_root(I.mmr_levels(leaves, "segment", stored), first.select("segment", "n"), "segment").select("segment", F.col("root").alias("mmr_root"))
    return files.join(first, "segment").join(roots, "segment").select("segment", "size", "file_sha256", F.col("n").alias("leaf_count"), "chain_tip", "mmr_root")


def manifest(rows: DataFrame, segment: str, order: str, line: str) -> DataFrame:
    """segment, n, size, digest and tip of rows written as lines; segments are of bounded size."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line])
    agg = rows.groupBy(segment).agg(F.count("*").alias("n"), F.sum(F.octet_length(line) + 1).alias("size"), lines.alias("_l"))
    return agg.select(segment, "n", "size", F.sha2(F.array_join("_l", "\n"), 256).alias("digest"), F.sha2(F.element_at("_l", -1), 256).alias("tip"))


def manifest_diff(source: DataFrame, backup: DataFrame, segment: str) -> DataFrame:
    """What differs between the manifests of a source and its backup: count, size, digest, tip, or the segment is missing or extra."""
    facts = ["n", "size", "digest", "tip"]
    side = lambda df, k: df.select(segment, *[F.col(c).alias(f"{k}_{c}") for c in facts])
    both = side(source, "source").join(side(backup, "backup"), segment, "full_outer")
    differs = F.array(*[F.when(F.col(f"source_{c}") != F.col(f"backup_{c}"), "count" if c == "n" else c) for c in facts])
    status = F.when(F.col("backup_n").isNull(), "missing").when(F.col("source_n").isNull(), "extra").otherwise(F.array_join(F.filter(differs, lambda x: x.isNotNull()), ","))
    return both.select(segment, "source_n", "backup_n", status.alias("differs"))


def _escaped(c: Column, marks: str) -> Column:
    """c with a backslash before backslashes and the marks; line ends as two characters."""
    for m in "\\" + marks:
        c = F.replace(c, F.lit(m), F.lit("\\" + m))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def siem_lines(events: DataFrame, fields: dict[str, Column], id_col: str) -> DataFrame:
    """CEF, RFC 5424, Splunk and Datadog lines of events. fields, in the order of their names, with event_id, event_kind, severity
    (0 to 10) and timestamp (text) among them."""
    text = {k: v.cast("string") for k, v in fields.items()}
    json = lambda source: F.to_json(F.struct(*[v.alias(k) for k, v in sorted({**fields, "source": F.lit(source)}.items())]))
    pairs = lambda form: F.concat_ws(" ", *[form(k, v) for k, v in text.items()])
    kind = _escaped(text["event_kind"], "|")
    cef = F.concat(F.lit("CEF:0|lakewarden|audit|1|"), kind, F.lit("|"), kind, F.lit("|"), text["severity"], F.lit("|"), pairs(lambda k, v: F.concat(F.lit(f"{k}="), _escaped(v, "="))))
    priority = (8 + F.least(F.lit(7), F.greatest(F.lit(0), 10 - fields["severity"]))).cast("string")
    data = pairs(lambda k, v: F.concat(F.lit(f'{k}="'), _escaped(v, '"]'), F.lit('"')))
    syslog = F.concat(F.lit("<"), priority, F.lit(">1 "), text["timestamp"], F.lit(" - lakewarden - "), text["event_id"], F.lit(" [audit@32473 "), data, F.lit("] -"))
    return events.select(id_col, json("splunk").alias("splunk"), json("datadog").alias("datadog"), cef.alias("cef"), syslog.alias("syslog"))


def stix_bundles(objects: DataFrame, order: list[str], stored, size: int) -> DataFrame:
    """(bundle, objects) of `size` objects each, in order: places come from dense_position, so no bundle is larger."""
    placed = dense_position(objects, order, stored, 16)
    return placed.groupBy(F.floor(F.col("position") / size).alias("bundle")).agg(F.sort_array(F.collect_list(F.struct("position", *[c for c in objects.columns if c not in order]))).alias("objects"))


def time_of(text) -> object:
    """A timestamp from text: whole microseconds since 1970, or an ISO date and time; null where it is neither."""
    micros = F.when(text.rlike(r"^-?[0-9]{1,18}$"), F.timestamp_micros(text.try_cast("long")))
    return F.coalesce(micros, F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), F.try_to_timestamp(text)))


def text_of(json) -> object:
    """The text of a JSON value that is a string; null for numbers, objects and what is no JSON."""
    return F.when(json.rlike(r'^".*"$'), F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"])
