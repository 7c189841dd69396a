"""Search, listing, validity and retention of audit records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_predicate(equal: dict[str, object] | None = None, since=None, until=None, ts: str = "ts", min_latency_ms: float | None = None, latency: str = "latency_ms") -> Column:
    """Conjunction of exact matches, inclusive time bounds and a latency floor that null never meets."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(ts) >= F.lit(since).cast("timestamp")] if since is not None else []
    tests += [F.col(ts) <= F.lit(until).cast("timestamp")] if until is not None else []
    tests += [F.col(latency) >= min_latency_ms] if min_latency_ms is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def forensic_search(records: DataFrame, predicate: Column, order: list[str], offset: int = 0, limit: int = 100, descending: bool = False) -> DataFrame:
    """A page of the matching records in a total order, each with the number of all matches."""
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    found = records.filter(predicate)
    return found.orderBy(*keys).offset(offset).limit(limit).join(F.broadcast(found.agg(F.count("*").alias("total"))))


def audit_listing(records: DataFrame, failures_only: bool = False) -> DataFrame:
    """Records with whole milliseconds and whether they failed."""
    failed = F.col("outcome").isNotNull() & (F.col("outcome") != "complete")
    out = records.withColumn("failed", failed).withColumn("latency_whole_ms", F.floor("latency_ms").cast("long"))
    return out.filter("failed") if failures_only else out


def node_lookup(records: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Records of many keys at once; Spark broadcasts the keys if they are few."""
    return records.join(keys.select(key).distinct(), key, "left_semi")


def invalid_reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks (a rule that is null is not broken), in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())


def quarantine_invalid(records: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reasons."""
    judged = records.withColumn("reasons", invalid_reasons(rules))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def record_rules(numbers: list[str], latency: str = "latency_ms", status: str = "status", statuses: tuple[str, ...] = ("committed", "rejected"), verdict: str = "verdict", verdicts: tuple[str, ...] = ("allow", "block"), digests: tuple[str, ...] = ()) -> dict[str, Column]:
    """Rules of audit records for quarantine_invalid, over rows that signature_material was joined to: non_finite (any of `numbers` is no finite number), negative_latency,
    status and verdict (not of their vocabularies; null is not), digest (a digest that is not 64 lower-case hex characters; null is none), scheme (not a known one), material (signature or
    key of another shape than the scheme's)."""
    finite = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in numbers], F.lit(False))
    shape = reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False)) for c in digests], F.lit(False))
    token = lambda c: F.coalesce(F.col(c).rlike("^([0-9a-f]{2})+$"), F.lit(False))
    size = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    key = F.when(F.col("_key_chars") == 0, size("public_key") != 0).when(F.col("_key_chars").isNull(), size("public_key") == 0).otherwise(size("public_key") != F.col("_key_chars"))
    material = ~token("signature") | ((size("public_key") > 0) & ~token("public_key")) | F.coalesce(size("signature") != F.col("_signature_chars"), F.lit(False)) | key
    return {
        "non_finite": F.coalesce(finite, F.lit(False)), "negative_latency": F.coalesce(F.col(latency) < 0, F.lit(False)), "status": ~F.coalesce(F.col(status).isin(*statuses), F.lit(False)), "verdict": ~F.coalesce(F.col(verdict).isin(*verdicts), F.lit(False)),
        "digest": shape, "scheme": F.col("_known").isNull(), "material": F.col("_known").isNotNull() & material,
    }


def signature_material(records: DataFrame, schemes: DataFrame, scheme: str = "signature_scheme") -> DataFrame:
    """records with what their scheme asks of signature and public_key. schemes: scheme, signature_chars (null: any), key_chars (0: no key, null: any key), one row a scheme."""
    asked = schemes.select(F.col("scheme").alias(scheme), F.col("signature_chars").alias("_signature_chars"), F.col("key_chars").alias("_key_chars"), F.lit(True).alias("_known"))
    return records.join(asked, scheme, "left")


def retention_status(records: DataFrame, policies: DataFrame, as_of: str, sealed_at: str = "sealed_at", policy: str = "policy") -> DataFrame:
    """ACCESSIBLE, LONG_TERM or PURGE_ELIGIBLE by the years (365.25 days) of each record's policy.

    policies: policy, accessible_years, total_years."""
    years = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(sealed_at).cast("timestamp"))) / (365.25 * 86400)
    joined = records.join(policies, policy, "left").withColumn("age_years", years)
    status = F.when(F.col("age_years") < F.col("accessible_years"), "ACCESSIBLE").when(F.col("age_years") < F.col("total_years"), "LONG_TERM").when(F.col("total_years").isNotNull(), "PURGE_ELIGIBLE")
    return joined.withColumn("status", status)


def threat_anonymize(events: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Events above a score without identifiers: hour, class by score, digest of the normalised pattern."""
    level = F.when(F.col("waf_score") >= 0.9, "critical").when(F.col("waf_score") >= 0.7, "high").otherwise("medium")
    digest = F.sha2(F.regexp_replace(F.lower("endpoint"), r"[^a-z0-9]+", " "), 256)
    return events.filter(F.col("waf_score") >= min_score).select(F.date_trunc("hour", "ts").alias("hour"), level.alias("event_class"), digest.alias("pattern_sha256"), F.round("waf_score", 2).alias("score"))


def clock_drift(rows: DataFrame, reference: str, local: str, tolerance_s: float = 5.0) -> DataFrame:
    """Seconds between two clocks and whether they are further apart than the tolerance."""
    drift = F.abs(F.unix_micros(reference) - F.unix_micros(local)) / 1e6
    return rows.withColumn("drift_s", drift).withColumn("drifted", drift > tolerance_s)


def dense_position(rows: DataFrame, order: list[str], stored, partitions: int) -> DataFrame:
    """0-based position in a total order without a single-partition window.

    Range-partitioned and written by `stored` first, so that partition numbers stay; partition counts give offsets."""
    from pyspark.sql.window import Window

    dealt = stored(rows.repartitionByRange(partitions, *[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))  # one row a partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return dealt.join(offsets, "_pid").withColumn("position", F.col("_offset") + F.row_number().over(inside) - 1).drop("_pid", "_offset")
