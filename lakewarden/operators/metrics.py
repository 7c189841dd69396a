"""Aggregations over requests, texts and governance records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import bounded


def traffic_rollup(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over every prefix of the keys; grouping_bits tells totals from null keys."""
    return requests.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status_class") == "5xx").alias("errors"), F.grouping_id().cast("long").alias("grouping_bits"))


def latency_histogram(requests: DataFrame, by: str, value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound (null: no bound), in one pass."""
    sums = requests.groupBy(by).agg(F.array(*[F.count_if(value <= b) for b in bounds], F.count(value)).alias("counts"))
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double"))
    return sums.select(by, F.posexplode(F.arrays_zip(les.alias("le"), F.col("counts").alias("cumulative"))).alias("pos", "x")).select(by, "x.le", F.col("x.cumulative").alias("cumulative"))


def histogram_quantile(histogram: DataFrame, by: str, q: float) -> DataFrame:
    """Linear interpolation in the first finite bucket that reaches q of the whole count."""
    total = Window.partitionBy(by)
    order = Window.partitionBy(by).orderBy("le")
    h = histogram.withColumn("_target", q * F.max("cumulative").over(total)).filter("le is not null")
    h = h.withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
    h = h.filter((F.col("cumulative") >= F.col("_target")) & (F.col("cumulative") > 0))
    value = F.when(F.col("cumulative") == F.col("_below"), F.col("le")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_target") - F.col("_below")) / (F.col("cumulative") - F.col("_below")))
    return h.groupBy(by).agg(F.min(F.struct("le", value.alias("v")))["v"].alias("quantile"))


def latency_percentiles(requests: DataFrame, by: str, value: str) -> DataFrame:
    """Observed values at p50, p95 and p99, and the largest."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return requests.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("max"), F.count("*").alias("n"))


def first_deliveries(events: DataFrame, key: str = "request_id", ts: str = "ts") -> DataFrame:
    """Of rows that were delivered several times, the earliest (ties by all columns)."""
    others = [c for c in events.columns if c not in (key, ts)]
    return events.groupBy(key).agg(F.min(F.struct(ts, *others)).alias("_m")).select(key, "_m.*")


def usage_metering(events: DataFrame, keys: list[str], max_tokens: int = 10_000_000, max_tools: int = 1000) -> DataFrame:
    """Billable tokens and tool calls per key and day, each request once at its first delivery, values capped; without a
    count of its own a text is a token for every four characters (columns input_chars, output_chars, where given)."""
    once = first_deliveries(events)
    count = lambda c: F.coalesce(F.col(f"{c}_tokens"), F.floor(F.col(f"{c}_chars") / 4) if f"{c}_chars" in events.columns else F.lit(0))
    capped = lambda c, m: F.sum(F.least(c, F.lit(m)))
    sums = [capped(count("input"), max_tokens).alias("input_tokens"), capped(count("output"), max_tokens).alias("output_tokens")]
    sums += [capped(F.col("tool_calls"), max_tools).alias("tool_calls")] if "tool_calls" in events.columns else []
    return once.groupBy(*keys, F.to_date("ts").alias("day")).agg(*sums, F.count("*").alias("requests"))


GOOD_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def named_well(requests: DataFrame, org: str) -> DataFrame:
    """Requests of organisations whose names are letters, digits, dots, hyphens and underscores, 64 at most; the others can't be billed."""
    return requests.filter(F.col(org).rlike(GOOD_NAME))


def usage_batches(events: DataFrame, org: str, stored, size: int = 100, partitions: int = 16) -> DataFrame:
    """Idempotent batches of up to `size` request ids per organisation in the order of time, named by the digest of what they
    hold. Places come from range partitions and offsets, so a large organisation spreads over tasks."""
    order = [org, "ts", "request_id"]
    dealt = stored(first_deliveries(events).repartitionByRange(partitions, *order).withColumn("_pid", F.spark_partition_id()))
    counts = dealt.groupBy(org, "_pid").agg(F.count("*").alias("_n"))  # as many rows as partitions and organisations meet
    before = Window.partitionBy(org).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(org, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy(org, "_pid").orderBy("ts", "request_id")) - 1
    numbered = dealt.join(offsets, [org, "_pid"]).withColumn("batch", F.floor(place / size))
    ids = F.sort_array(F.collect_list(F.col("request_id").cast("string")))
    out = numbered.groupBy(org, "batch").agg(ids.alias("ids"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(org, "batch", F.size("ids").alias("n"), "output_tokens", F.sha2(F.concat(F.col(org), F.lit("\n"), F.array_join("ids", "\n")), 256).alias("batch_id"))


def redaction_totals(rows: DataFrame, by: str, hits: str) -> DataFrame:
    """Sums of per-row maps of counts by key and entity."""
    return rows.select(by, F.explode(hits).alias("entity", "n")).groupBy(by, "entity").agg(F.sum("n").alias("total"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate; (0, 1) where n is 0."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def detector_scorecard(scored: DataFrame, by: str, blocked: Column, positive: Column, critical: Column | None = None) -> DataFrame:
    """Bypasses and false positives of a detector with Wilson bounds and a gate (<5 % bypass, no critical one, no false positive). critical: of the positives, those
    that must never pass."""
    missed = F.count_if(positive & ~blocked & (F.lit(False) if critical is None else critical)).alias("critical_bypasses")
    agg = scored.groupBy(by).agg(F.count_if(positive).alias("positives"), F.count_if(positive & ~blocked).alias("bypasses"), missed, F.count_if(~positive).alias("negatives"), F.count_if(~positive & blocked).alias("false_positives"))
    low, high = wilson(F.col("bypasses"), F.col("positives"))
    rate = F.when(F.col("positives") > 0, F.col("bypasses") / F.col("positives")).otherwise(0.0)
    return agg.select("*", rate.alias("bypass_rate"), low.alias("bypass_low"), high.alias("bypass_high"), ((rate < 0.05) & (F.col("critical_bypasses") == 0) & (F.col("false_positives") == 0)).alias("passed"))


def case_summary(records: DataFrame, case: str, scheme: str = "scheme", scrubbed: str = "scrubbed", intact: str = "intact") -> DataFrame:
    """Aggregates of an investigation report: records, time span, models, schemes, sessions, blocked, scrubbed (records with something redacted), broken (records that do not verify) and the
    integrity they make: INTACT, BROKEN, or UNKNOWN where one was not verified."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = records.groupBy(case).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), names("model").alias("models"), names(scheme).alias("schemes"), F.count_distinct("session_id").alias("sessions"),
        F.count_if(~F.col("allowed")).alias("blocked"), F.count_if(F.col(scrubbed) > 0).alias("scrubbed"), F.count_if(~F.col(intact)).alias("broken"), F.count_if(F.col(intact).isNull()).alias("_open"),
    )
    return out.withColumn("integrity", F.when(F.col("broken") > 0, "BROKEN").when(F.col("_open") > 0, "UNKNOWN").otherwise("INTACT")).drop("_open")


def wal_depth(records: DataFrame, segment: str, size: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """Rows and bytes of each segment, and why it is too deep."""
    agg = records.groupBy(segment).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))
    reasons = F.filter(F.array(F.when(F.col("entries") > max_rows, "entries"), F.when(F.col("bytes") > max_bytes, "bytes")), lambda x: x.isNotNull())
    return agg.withColumn("reasons", F.array_join(reasons, ",")).withColumn("over", F.size(reasons) > 0)


def chain_assurance(records: DataFrame, chain: str, schemes: DataFrame, scheme: str, pinned: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The weakest signature tier of each chain and its records by tier (`tier:n`, from the weakest, comma-joined); keys outside `pinned` count as UNSIGNED (rank 0).
    schemes: scheme, rank, tier."""
    joined = records.join(schemes, scheme, "left")
    if pinned is not None:
        joined = joined.join(pinned.select(key).distinct().withColumn("_pinned", F.lit(True)), key, "left")
        joined = joined.withColumn("rank", F.when(F.col("_pinned"), F.col("rank")).otherwise(0)).withColumn("tier", F.when(F.col("_pinned"), F.col("tier")).otherwise("UNSIGNED"))
    tiers = joined.groupBy(chain, F.coalesce("rank", F.lit(0)).alias("r"), F.coalesce("tier", F.lit("UNSIGNED")).alias("t")).agg(F.count("*").alias("k"))  # a row a tier
    out = tiers.groupBy(chain).agg(F.sort_array(F.collect_list(F.struct("r", "t", "k"))).alias("_t"), F.sum("k").alias("n"), F.sum(F.when(F.col("r") == 0, F.col("k")).otherwise(0)).alias("unsigned"))
    counts = F.array_join(F.transform("_t", lambda x: F.concat(x["t"], F.lit(":"), x["k"].cast("string"))), ",")
    return out.select(chain, F.col("_t")[0]["t"].alias("weakest"), "unsigned", "n", counts.alias("tiers"))


def sox_report(models: DataFrame, as_of: str) -> DataFrame:
    """Whether each group's material models are all approved and none rejected or pending. models: grp, model_id, material, state, state_at."""
    seen = models.filter(F.col("material") & (F.col("state_at") <= F.lit(as_of).cast("timestamp")))
    return seen.groupBy("grp").agg(F.count_distinct("model_id").alias("models"), F.count_if(F.col("state") == "approved").alias("approved"), F.count_if(F.col("state") == "rejected").alias("rejected"), F.bool_and(F.col("state") == "approved").alias("effective"))


def traceability_coverage(links: DataFrame, kinds: list[str]) -> DataFrame:
    """Link kinds that each requirement lacks. links: requirement, kind (null kind: none)."""
    have = links.groupBy("requirement").agg(F.sort_array(F.collect_set("kind")).alias("have"))
    return have.select("requirement", F.size("have").alias("n_kinds"), F.array_join(F.array_except(F.array(*map(F.lit, kinds)), "have"), ",").alias("missing"), (F.size(F.array_except(F.array(*map(F.lit, kinds)), "have")) == 0).alias("covered"))


def acceptance_criteria(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """criteria (metric, comparator, threshold) against metrics (run, metric, value); a missing metric fails."""
    runs = metrics.select("run").distinct()
    joined = runs.join(bounded(criteria)).join(metrics, ["run", "metric"], "left")
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("comparator") == "<=", v <= t).when(F.col("comparator") == "<", v < t).when(F.col("comparator") == ">=", v >= t).when(F.col("comparator") == ">", v > t).when(F.col("comparator") == "==", v == t)
    return joined.withColumn("met", F.coalesce(ok, F.lit(False))).groupBy("run").agg(F.count_if("met").alias("met"), F.count("*").alias("criteria"), F.bool_and("met").alias("passed"))


def dp_count(rows: DataFrame, by: str, epsilon: float, seed: int) -> DataFrame:
    """Laplace-noised counts, sensitivity 1. The seed is to be secret and new for each release: the noise of a known one can be
    subtracted."""
    u = F.rand(seed) - 0.5
    noise = -F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300))) / epsilon
    return rows.groupBy(by).agg(F.count("*").alias("n")).select(by, (F.col("n") + noise).alias("noisy"))


def routing_entropy(vectors: DataFrame, key: str, gates: str, bound: float) -> DataFrame:
    """Normalised entropy of each gate vector, its largest gate, and whether the entropy exceeds a bound."""
    total = F.aggregate(gates, F.lit(0.0), lambda s, x: s + x)
    share = F.transform(gates, lambda x: x / total)
    h = -F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0)) / F.log2(F.size(gates))
    return vectors.select(key, h.alias("entropy"), F.array_max(share).alias("max_gate"), (h > bound).alias("entangled"))


def activation_bound(samples: DataFrame, gates: str, norms: list[float], q: float = 0.99) -> DataFrame:
    """One row, bound: the quantile of the activations (gates weighted by norms) of a calibration sample, interpolated."""
    return samples.agg(F.percentile(_activation(F.col(gates), norms), q).alias("bound"))


def _activation(gates: Column, norms: list[float]) -> Column:
    return F.aggregate(F.zip_with(gates, F.array(*[F.lit(float(x)) for x in norms]), lambda g, w: g * w), F.lit(0.0), lambda s, x: s + x)


def routing_monitor(vectors: DataFrame, key: str, gates: str, norms: list[float], bound: DataFrame, gate_threshold: float = 0.5, least: int = 2) -> DataFrame:
    """Gate vectors against a calibrated activation: status and why, with entropy (nats), activation and the largest gate of the normalised vector.

    INSUFFICIENT_DATA: under `least` gates; INVALID_INPUT: a gate outside 0 to 1; CATASTROPHIC_ROUTING: all are 0; ENTANGLEMENT_DETECTED: the activation exceeds the bound with no gate at
    the threshold (absolute), or three quarters of it with an entropy above half of the greatest (distributed); else NOMINAL. bound: one row, as activation_bound gives it; a null bound makes
    NOT_CALIBRATED."""
    total = F.aggregate(gates, F.lit(0.0), lambda s, x: s + x)
    t = vectors.join(F.broadcast(bound)).withColumn("_n", F.size(gates)).withColumn("_odd", F.exists(gates, lambda x: x.isNull() | (x < 0) | (x > 1))).withColumn("_sum", total)
    t = t.withColumn("_p", F.when((F.col("_sum") > 0) & ~F.col("_odd"), F.transform(gates, lambda x: x / F.col("_sum"))))
    t = t.withColumn("entropy", -F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.greatest(p, F.lit(1e-15)) * F.log(F.greatest(p, F.lit(1e-15))))).withColumn("activation", _activation(F.col("_p"), norms)).withColumn("max_gate", F.array_max("_p"))
    absolute = (F.col("activation") > F.col("bound")) & (F.col("max_gate") < gate_threshold)
    distributed = (F.col("entropy") > F.log(F.col("_n")) / 2) & (F.col("activation") > 0.75 * F.col("bound"))
    status = (
        F.when(F.col("_n") < least, "INSUFFICIENT_DATA").when(F.col("_odd"), "INVALID_INPUT").when(F.col("_sum") == 0, "CATASTROPHIC_ROUTING").when(F.col("bound").isNull(), "NOT_CALIBRATED")
        .when(absolute | distributed, "ENTANGLEMENT_DETECTED").otherwise("NOMINAL")
    )
    reasons = F.array_join(F.filter(F.array(F.when(absolute, "absolute"), F.when(distributed, "distributed")), lambda x: x.isNotNull()), ",")
    return t.select(key, status.alias("status"), F.when(status == "ENTANGLEMENT_DETECTED", reasons).alias("reasons"), "entropy", "activation", "max_gate")


def distinct_entities(requests: DataFrame, hour: Column) -> DataFrame:
    return requests.groupBy(hour.alias("hour")).agg(F.count_distinct("tenant_id").alias("tenants"), F.count_distinct("model").alias("models"), F.count_distinct("session_id").alias("sessions"))
