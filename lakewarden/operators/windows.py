"""Window jobs: session rules, drift, burn rates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import ema_scan, with_neighbours


def session_escalation(turns: DataFrame, session: str, order: str, window: int = 10, limit: float = 2.0, streak: int = 3) -> DataFrame:
    """Per turn: the sum of scores over the last turns, the run of soft hits (score > 0 and allowed), the first rule met."""
    w = Window.partitionBy(session).orderBy(order)
    soft = (F.col("score") > 0) & F.col("allowed")
    t = turns.withColumn("window_score", F.round(F.sum("score").over(w.rowsBetween(1 - window, 0)), 6))
    t = t.withColumn("_island", F.sum((~soft).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(soft.cast("int")).over(Window.partitionBy(session, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("streak", F.when(soft, run).otherwise(0)).drop("_island")
    return t.withColumn("rule", F.when(F.col("window_score") >= limit, "window_score").when(F.col("streak") >= streak, "streak"))


def conversation_erosion(turns: DataFrame, session: str, order: str, value: str, score: str, drop: float = 0.8, decline: int = 4) -> DataFrame:
    """Per turn: fall of a value from its baseline (mean of the first three), length of the strictly declining run, the rule met.

    The decline rule comes first; the fall's threshold is halved where the window score is 0.5 or more."""
    w = Window.partitionBy(session).orderBy(order)
    t = turns.withColumn("_n", F.row_number().over(w))
    base = F.avg(F.when(F.col("_n") <= 3, F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("fall", F.round(base - F.avg(value).over(w.rowsBetween(-2, 0)), 6)).withColumn("_up", F.coalesce((F.lag(value).over(w) <= F.col(value)).cast("int"), F.lit(1)))
    t = t.withColumn("_island", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("declining", F.least(F.count("*").over(Window.partitionBy(session, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(10)))
    t = t.withColumn("_score", F.sum(score).over(w.rowsBetween(-9, 0)))
    limit = F.when(F.round("_score", 6) >= 0.5, drop / 2).otherwise(drop)
    rule = F.when((F.col("_n") >= 2) & (F.col("declining") >= decline), "decline").when((F.col("_n") >= 2) & (F.col("fall") >= limit), "drop")
    return t.withColumn("rule", rule).drop("_n", "_up", "_island", "_score")


def entropy_outlier(rows: DataFrame, key: str, order: list[str], value: str, history: int = 50, least: int = 10, sigmas: float = 2.0) -> DataFrame:
    """Values further than `sigmas` population deviations from the mean of those before."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-history, -1)
    t = rows.withColumn("mean", F.round(F.avg(value).over(w), 6)).withColumn("sigma", F.round(F.stddev_pop(value).over(w), 6)).withColumn("_n", F.count(value).over(w))
    return t.withColumn("outlier", F.coalesce((F.col("_n") >= least) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sigma")), F.lit(False))).drop("_n")


def ema_variance(rows: DataFrame, key: str, order: str, value: str, stored, alpha: float = 0.1, window: int = 20) -> DataFrame:
    """Exponential moving average seeded by the first value, and the trailing population variance, to six decimals (see scans.ema_scan)."""
    out = ema_scan(rows, key, [order], value, stored, alpha, window)
    return out.withColumn("ema", F.round("ema", 6)).withColumn("variance", F.round("variance", 6))


def kl_bits(p: Column, q: Column, floor: float = 1e-12) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(a / F.greatest(b, F.lit(floor)))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def js_bits(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl_bits(p, m) + kl_bits(q, m)) / 2


def softmax(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """Rows with the softmax of a vector column as `name`; step by step, so that no sum is taken once per element."""
    t = rows.withColumn("_top", F.array_max(vector)).withColumn("_e", F.transform(vector, lambda x: F.exp(x - F.col("_top"))))
    t = t.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))
    return t.withColumn(name, F.transform("_e", lambda x: x / F.col("_sum"))).drop("_top", "_e", "_sum")


def entropy_bits(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def padded(p: Column, q: Column) -> Column:
    """p with zeros up to the length of q."""
    return F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.size(q) - F.size(p), F.lit(0))))


def distribution_drift(rows: DataFrame, session: str, response: str, order: str, dist: str, stored, *, kl_limit: float = 2.0, js_limit: float = 0.5, drop_bits: float = 1.0, least: int = 3) -> DataFrame:
    """Each token's distribution against the one before and the session's first: session, response, order, entropy, kl_prev, kl_base, js_prev, saturated, alert, severity,
    collapse, collapse_severity.

    Responses of under `least` tokens are left out. Distributions may differ in length (the shorter one has zeros): one that gives weight where the one before has none is
    saturated, its KL is without bound (null), and JS decides. alert: JS_SPIKE (saturated and JS above its limit), KL_SPIKE (KL to the one before above its
    limit, CRITICAL above three times that), else SEMANTIC_DRIFT (KL to the first above twice the limit, or without bound). collapse: entropy `drop_bits` below the session's first,
    MEDIUM, or CRITICAL beyond three times that; it is the alert where there is no other. The row before and the first one are carried over range
    partitions: a session may hold any share of the rows."""
    enough = rows.groupBy(session, response).agg(F.count("*").alias("_k")).filter(F.col("_k") >= least).select(session, response)
    t = with_neighbours(rows.join(enough, [session, response]), [session], [order], [dist], stored)
    p, q, base = F.col(dist), F.col(f"before.{dist}"), F.col(f"first.{dist}")
    open_to = lambda a, b: F.exists(F.slice(a, F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0))), lambda x: x > 0)
    t = t.withColumn("saturated", F.when(q.isNotNull(), (F.size(p) > F.size(q)) & open_to(p, q))).withColumn("_far", (F.size(p) > F.size(base)) & open_to(p, base))
    t = t.withColumn("entropy", F.round(entropy_bits(p), 6)).withColumn("_drop", F.round(entropy_bits(base) - entropy_bits(p), 6))
    t = t.withColumn("kl_prev", F.when(~F.col("saturated"), F.round(kl_bits(padded(p, q), padded(q, p)), 6))).withColumn("kl_base", F.when(~F.col("_far"), F.round(kl_bits(padded(p, base), padded(base, p)), 6)))
    t = t.withColumn("js_prev", F.when(q.isNotNull(), F.round(js_bits(padded(p, q), padded(q, p)), 6)))
    spike, js = F.coalesce(F.col("kl_prev") > kl_limit, F.lit(False)), F.coalesce(F.col("saturated") & (F.col("js_prev") > js_limit), F.lit(False))
    drift = F.col("_far") | F.coalesce(F.col("kl_base") > 2 * kl_limit, F.lit(False))
    fallen = F.col("_drop") > drop_bits
    collapse = F.when(fallen, F.when(F.col("_drop") > 3 * drop_bits, "CRITICAL").otherwise("MEDIUM"))
    alert = F.when(spike, "KL_SPIKE").when(js, "JS_SPIKE").when(drift, "SEMANTIC_DRIFT").when(fallen, "ENTROPY_COLLAPSE")
    severity = F.when(spike & (F.col("kl_prev") > 3 * kl_limit), "CRITICAL").when(spike | js | drift, "HIGH").otherwise(collapse)
    return t.select(session, response, order, "entropy", "kl_prev", "kl_base", "js_prev", "saturated", alert.alias("alert"), severity.alias("severity"), fallen.alias("collapse"), collapse.alias("collapse_severity"))


def drift_responses(tokens: DataFrame, session: str, response: str) -> DataFrame:
    """Responses of distribution_drift: tokens, mean, least and greatest entropy, alerts (a collapse beside another alert is one more), critical ones."""
    both = F.col("collapse") & (F.col("alert") != "ENTROPY_COLLAPSE")
    alerts = F.sum(F.col("alert").isNotNull().cast("int") + F.coalesce(both, F.lit(False)).cast("int")).cast("long")
    critical = F.sum((F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))).cast("int") + F.coalesce(both & (F.col("collapse_severity") == "CRITICAL"), F.lit(False)).cast("int")).cast("long")
    return tokens.groupBy(session, response).agg(F.count("*").alias("tokens"), F.round(F.avg("entropy"), 6).alias("mean_entropy"), F.min("entropy").alias("min_entropy"), F.max("entropy").alias("max_entropy"), alerts.alias("alerts"), critical.alias("critical"))


#: (long seconds, short seconds, burn factor) of the multi-window alerts.
BURN_WINDOWS = ((3600, 300, 14.4), (21600, 1800, 6.0), (86400, 7200, 3.0), (259200, 21600, 1.0))


def slo_burn_rate(requests: DataFrame, service: str, failed: Column, budget: float) -> DataFrame:
    """Minutes in which both windows of a pair burn the error budget too fast. Pre-aggregated to minutes per service.

    A window's sum is the running sum less the running sum at its start, so each row is added once to each, however long the window."""
    minute = requests.groupBy(service, (F.floor(F.unix_timestamp("ts") / 60) * 60).alias("minute")).agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    w = Window.partitionBy(service).orderBy("minute")
    until = lambda c, s: F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, -s)), F.lit(0))
    spans = sorted({s for a, b, _ in BURN_WINDOWS for s in (a, b)})
    sums = minute.withColumns({f"_{c}{s}": until(c, s) for c in ("n", "bad") for s in (0, *spans)})
    ratio = lambda s: (F.col("_bad0") - F.col(f"_bad{s}")) / (F.col("_n0") - F.col(f"_n{s}"))
    fired = [F.when((ratio(a) > budget * f) & (ratio(b) > budget * f), F.lit(f"{a // 3600}h")) for a, b, f in BURN_WINDOWS]
    out = sums.withColumn("windows", F.array_join(F.filter(F.array(*fired), lambda x: x.isNotNull()), ","))
    return out.filter("windows <> ''").select(service, "minute", "windows")


def counter_rate(samples: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Per-second rates of cumulative counters; null where the counter fell."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return samples.withColumn("rate", F.when(F.col(value) >= F.lag(value).over(w), F.round((F.col(value) - F.lag(value).over(w)) / seconds, 9)))


def latest_per_key(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *values), order).alias("m")).select(key, *[F.col(f"m.{v}").alias(v) for v in [order, *values]])


def outage_openings(rows: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 5) -> DataFrame:
    """Runs of `threshold` failures in a row and more: start, end, length."""
    w = Window.partitionBy(key).orderBy(*order)
    t = rows.withColumn("_f", failed).withColumn("_island", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_f")
    return t.groupBy(key, "_island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("failures")).filter(F.col("failures") >= threshold).drop("_island")


def log_gap_check(rows: DataFrame, log: str, index: str, ts: str) -> DataFrame:
    """Missing and repeated indexes and steps back in time, per log."""
    w = Window.partitionBy(log).orderBy(index)
    t = rows.withColumn("_i", F.lag(index).over(w)).withColumn("_t", F.lag(ts).over(w))
    return t.groupBy(log).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(index) > F.col("_i") + 1, F.col(index) - F.col("_i") - 1)), F.lit(0)).alias("missing"), F.count_if(F.col(index) == F.col("_i")).alias("repeated"), F.count_if(F.col(ts) < F.col("_t")).alias("backwards"))


def custody_chain(rows: DataFrame, package: str, order: str, giver: str, taker: str) -> DataFrame:
    """Whether each hand-off's taker gives next, and who holds the package."""
    w = Window.partitionBy(package).orderBy(order)
    t = rows.withColumn("_next", F.lead(giver).over(w))
    return t.groupBy(package).agg(F.count("*").alias("handoffs"), F.count_if(F.col("_next") != F.col(taker)).alias("breaks"), F.max_by(taker, order).alias("holder"))
