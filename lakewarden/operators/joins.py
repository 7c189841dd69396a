"""Joins: fuzzy, range, as-of, reconciliation, policy."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import hamming
from .textjobs import lsh_bands  # noqa: F401  of this module's callers too

MOST_ROWS = 10_000  # of a small table that every row of another meets


def bounded(df: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """df, to be broadcast if it has `rows` rows at most, counted; a larger one Spark joins as it sees fit, in blocks."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _sliding(tenants: int, look_back_s: int):
    """Rows of a template, band and hour in the order of arrival -> alerts of its own rows. Held: a count for each second of the look-back, and when each tenant
    was last seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("fingerprint", "band", "hour", "second", "micros", "id", "tenant", "own")], strict=True)
            for fingerprint, band, hour, second, micros, id_, tenant, own in rows:
                if (fingerprint, band, hour) != current:
                    current, last, by_second, seen, waiting = (fingerprint, band, hour), {}, deque(), 0, deque()
                # by_second: second, rows, first time of it; waiting: tenants by the second they were seen, stale where seen again
                if by_second and by_second[-1][0] == second:
                    by_second[-1][1] += 1
                else:
                    by_second.append([second, 1, micros])
                seen += 1
                if last.get(tenant) != second:
                    last[tenant] = second
                    waiting.append((second, tenant))
                while by_second[0][0] < second - look_back_s:
                    seen -= by_second.popleft()[1]
                while waiting[0][0] < second - look_back_s:
                    then, who = waiting.popleft()
                    if last[who] == then:
                        del last[who]
                if own and len(last) >= tenants:
                    out.append((id_, band, len(last), ",".join(sorted(last)), seen, by_second[0][2]))
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], ["id", "band", "n_tenants", "tenants", "n_seen", "first"])

    return run


def xsession_correlate(prints: DataFrame, *, look_back_s: int = 3600, distance: int = 8, tenants: int = 3, bands: int = 8) -> DataFrame:
    """Observations whose fingerprint comes near those of enough tenants within the look-back, by band: id, band, n_tenants, tenants, n_seen, first_seen.

    prints: id, tenant, ts, fingerprint; read several times, so written. Equal (fingerprint, tenant, ts) are one row to the join. Only earlier arrivals (ties by id) and
    the row itself count. No pairs of observations are made: different fingerprints that are near are paired once, whatever their copies (near_prints), and
    each fingerprint's observations and those of its neighbours with a common band pass in the order of time, by hour, through a sliding count of tenants."""
    seen = prints.filter("fingerprint <> 0").groupBy("fingerprint", "tenant", "ts").agg(F.min("id").alias("id"))
    hour = F.floor(F.unix_timestamp("ts") / look_back_s)
    different = prints.filter("fingerprint <> 0").select("fingerprint").distinct()
    widths = WIDTHS if different.count() <= MANY_PRINTS else WIDE
    pairs = near_prints(different, different.select(F.col("fingerprint").alias("neighbour")), "fingerprint", "neighbour", distance, widths)
    width = 64 // bands
    common = F.filter(F.array(*[F.when(T.band(F.col("fingerprint"), i, width) == T.band(F.col("neighbour"), i, width), F.lit(i)) for i in range(bands)]), lambda b: b.isNotNull())
    near = pairs.select("fingerprint", "neighbour", F.explode(common).alias("band"))
    # a neighbour's row counts in the hours in which the fingerprint has rows itself
    asked = seen.select("fingerprint", hour.alias("hour")).distinct()
    rows = seen.select(F.col("fingerprint").alias("neighbour"), "tenant", "id", F.unix_timestamp("ts").alias("second"), F.unix_micros("ts").alias("micros"), hour.alias("_hour"))
    # all three sides grow with the corpus
    met = near.join(rows.hint("merge"), "neighbour").withColumn("hour", F.explode(F.array(F.col("_hour"), F.col("_hour") + 1))).join(asked.hint("merge"), ["fingerprint", "hour"])
    met = met.withColumn("own", (F.col("fingerprint") == F.col("neighbour")) & (F.col("hour") == F.col("_hour"))).select("fingerprint", "band", "hour", "second", "micros", "id", "tenant", "own")
    keys = ["fingerprint", "band", "hour"]
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = prints.schema["id"].dataType.simpleString()
    found = met.repartition(n, *keys).sortWithinPartitions(*keys, "micros", "id").mapInArrow(_sliding(tenants, look_back_s), f"id {id_type}, band int, n_tenants long, tenants string, n_seen long, first long")
    return found.withColumn("first_seen", F.timestamp_micros("first")).drop("first")


WIDTHS = (13, 13, 13, 13, 12)  # bits of the bands of near_prints
WIDE = (22, 21, 21)  # for many fingerprints: ten times the rows dealt, one in 250 of the rows met
MANY_PRINTS = 300_000


def _masks(width: int, flips: int) -> list[int]:
    """All numbers of `width` bits with `flips` set bits at most."""
    return [sum(1 << i for i in at) for k in range(flips + 1) for at in combinations(range(width), k)]


def near_prints(prints: DataFrame, others: DataFrame, left: str, right: str, distance: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Pairs of rows whose fingerprints (columns left and right) differ in `distance` bits at most, by an equi-join.

    Of k bands one differs in distance // k bits at most, so each row of `others`, the smaller table, is dealt once for
    each way to flip so many bits of a band; a pair counts at the first band where it meets."""
    flips, pairs = distance // len(widths), []

    def band(at: int, width: int):
        value = lambda c: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))
        own, masks = value(F.col(right)), F.array(*[F.lit(m).cast("long") for m in _masks(width, flips)])
        return value, F.transform(masks, lambda m: own.bitwiseXOR(m))

    for i, width in enumerate(widths):
        pairs.append((i, *band(sum(widths[:i]), width)))
    dealt = prints.select("*", F.posexplode(F.array(*[v(F.col(left)) for _, v, _ in pairs])).alias("_band", "_value"))
    asked = others.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("_band"), p.alias("_values")) for i, _, p in pairs])).alias("_b")).select(*others.columns, F.col("_b._band").alias("_band"), F.explode("_b._values").alias("_value"))
    # asked has many rows a fingerprint, which Spark's estimate leaves out: it would broadcast them
    met = dealt.join(asked.hint("merge"), ["_band", "_value"]).withColumn("distance", hamming(F.col(left), F.col(right))).filter(F.col("distance") <= distance)
    earlier = F.lit(False)
    for i, value, _ in pairs[:-1]:
        earlier = earlier | ((F.col("_band") > i) & (F.bit_count(value(F.col(left)).bitwiseXOR(value(F.col(right)))) <= flips))
    return met.filter(~earlier).drop("_band", "_value")


def ioc_match(prints: DataFrame, iocs: DataFrame, distance: int = 8) -> DataFrame:
    """Indicators within a Hamming distance of each text. iocs: ioc_id, ioc_print, and more."""
    return near_prints(prints, iocs, "fingerprint", "ioc_print", distance)


def cluster_match(prints: DataFrame, centroids: DataFrame, threshold: int = 10) -> DataFrame:
    """The nearest labelled centroid of each text, and whether it is within that centroid's threshold. centroids: label, centroid, and threshold, if each has its own (one row a
    label)."""
    own = F.col("threshold") if "threshold" in centroids.columns else F.lit(threshold)
    near = prints.join(bounded(centroids.withColumn("threshold", own))).withColumn("d", hamming(F.col("fingerprint"), F.col("centroid")).cast("int"))
    return near.groupBy("id").agg(F.min(F.struct("d", "label", "threshold")).alias("m")).select("id", F.col("m.label").alias("label"), F.col("m.d").alias("distance"), (F.col("m.d") <= F.col("m.threshold")).alias("matched"))


def atlas_enrich(hits: DataFrame, category: str, mapping: DataFrame) -> DataFrame:
    """Techniques of each hit's normalised category; hits without any stay. mapping: category, technique."""
    keyed = hits.withColumn("_key", F.translate(F.lower(category), " -", "__"))
    techniques = mapping.groupBy(F.col("category").alias("_key")).agg(F.array_join(F.sort_array(F.collect_set("technique")), ",").alias("techniques"))
    return keyed.join(techniques, "_key", "left").drop("_key")


def exchange_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn and the assistant turn that follows it at once."""
    u = turns.filter("role = 'user'").select("session_id", "turn", F.col("text").alias("prompt"))
    a = turns.filter("role = 'assistant'").select("session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["session_id", "turn"])


def range_check(claims: DataFrame, reference: DataFrame, key: str, value: Column, low: str, high: str) -> DataFrame:
    """Claims against the range of their key: in_range, below, above or unknown."""
    r = reference.select(key, low, high)
    status = F.when(F.col(low).isNull(), "unknown").when(value < F.col(low), "below").when(value > F.col(high), "above").otherwise("in_range")
    return claims.join(r, key, "left").withColumn("status", status)


def code_domain_mismatch(responses: DataFrame, requests: DataFrame, key: str, code: str, domain: Column) -> DataFrame:
    """Codes of the response whose domain is in none of the request's codes."""
    asked = requests.select(key, domain.alias("domain")).distinct()
    return responses.select(key, code, domain.alias("domain")).distinct().join(asked, [key, "domain"], "left_anti")


def merge_replicas(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows, and remote ones whose key is not local."""
    return local.unionByName(remote.join(local.select(key).distinct(), key, "left_anti"))


def replica_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Records only in a, only in b, in both."""
    side = lambda df, name: df.select(*columns).distinct().withColumn(name, F.lit(True))
    joined = side(a, "_a").join(side(b, "_b"), columns, "full_outer")
    return joined.select(*columns, F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both").alias("side"))


def sequence_reconcile(sequence: DataFrame, chain: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Global sequence entries against a chain's nodes: what differs, is absent or was never sequenced."""
    s, c = sequence.select(*keys, F.col(digest).alias("_s")), chain.select(*keys, F.col(digest).alias("_c"))
    status = F.when(F.col("_c").isNull(), "absent").when(F.col("_s").isNull(), "unsequenced").when(F.col("_s") != F.col("_c"), "different").otherwise("ok")
    return s.join(c, keys, "full_outer").select(*keys, status.alias("status"))


def replica_compare(replicas: DataFrame) -> DataFrame:
    """Pairs of replicas (replica, n, head; one row each): in sync, behind, ahead, diverged, or UNKNOWN where one did not report. best: whether b is whom a should sync
    with, the longest of those ahead of it (the first by name of equals)."""
    a = replicas.select(F.col("replica").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"))
    b = replicas.select(F.col("replica").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"))
    absent = F.col("na").isNull() | F.col("nb").isNull() | F.col("ha").isNull() | F.col("hb").isNull()
    status = F.when(absent, "UNKNOWN").when((F.col("na") == F.col("nb")) & (F.col("ha") == F.col("hb")), "NO_SYNC").when(F.col("na") < F.col("nb"), "SYNC_NEEDED").when(F.col("na") > F.col("nb"), "PEER_STALE").otherwise("DIVERGED")
    pairs = a.join(bounded(b), F.col("a") != F.col("b")).select("a", "b", "na", "nb", status.alias("status"))
    ahead = F.max(F.when(F.col("status") == "SYNC_NEEDED", F.col("nb")))
    target = pairs.join(pairs.groupBy(F.col("a").alias("_a")).agg(ahead.alias("_most")), F.col("a") == F.col("_a")).filter((F.col("status") == "SYNC_NEEDED") & (F.col("nb") == F.col("_most"))).groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_best"))
    return pairs.join(target, F.col("a") == F.col("_a"), "left").select("a", "b", "na", "nb", "status", F.coalesce(F.col("b") == F.col("_best"), F.lit(False)).alias("best"))


def access_mediation(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """Whether each subject may read each class of objects, and the first reason if not.

    subjects: subject, clearance, compartments, nation; objects: classification, compartments, noforn, rel_to - one row a class."""
    o = objects.select("classification", F.col("compartments").alias("needs"), "noforn", "rel_to")
    reason = (
        F.when(F.col("clearance") < F.col("classification"), "clearance")
        .when(F.size(F.array_except("needs", "compartments")) > 0, "compartment")
        .when(F.col("noforn") & (F.col("nation") != "US"), "noforn")
        .when((F.size("rel_to") > 0) & ~F.array_contains("rel_to", F.col("nation")), "releasability")
    )
    return subjects.join(bounded(o)).select("subject", "classification", F.array_join("needs", ",").alias("needs"), reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("")).alias("reason"))


def flow_policy(transfers: DataFrame, policy: DataFrame) -> DataFrame:
    """Transfers between domains under a policy matrix (src, dst, action); no row in it means denied."""
    return transfers.join(policy, ["src", "dst"], "left").withColumn("action", F.coalesce("action", F.lit("deny")))


def latest_as_of(records: DataFrame, key: str, ts: str, as_of: str, values: list[str]) -> DataFrame:
    """Each key's latest values at a time (ties by values)."""
    seen = records.filter(F.col(ts) <= F.lit(as_of).cast("timestamp"))
    return seen.groupBy(key).agg(F.max(F.struct(ts, *values)).alias("m")).select(key, *[F.col(f"m.{v}").alias(v) for v in [ts, *values]])


def deploy_gate(deployments: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """Deployments with their approved change ids; without one they are not authorised."""
    ok = approvals.groupBy(*keys).agg(F.sort_array(F.collect_set("change_id")).alias("changes"))
    out = deployments.join(ok, keys, "left")
    return out.withColumn("n_changes", F.coalesce(F.size("changes"), F.lit(0))).withColumn("n_changes", F.greatest("n_changes", F.lit(0))).withColumn("authorised", F.col("n_changes") > 0).drop("changes")


def top_matches(pairs: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    from pyspark.sql.window import Window

    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def stix_ingest(bundles: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Prompt indicators of STIX bundles (JSON text): id, name and the first quoted literal of 3 characters or more."""
    schema = "objects array<struct<type:string,id:string,name:string,pattern:string,labels:array<string>,relationship_type:string,source_ref:string,target_ref:string>>"
    o = bundles.select(F.explode(F.from_json(column, schema)["objects"]).alias("o")).select("o.*")
    literal = F.regexp_extract("pattern", "'([^']{3,})'", 1)
    return o.filter((F.col("type") == "indicator") & F.arrays_overlap("labels", F.array(*map(F.lit, labels)))).select("id", "name", literal.alias("literal"))


def stix_link(bundles: DataFrame, column: str, stored=None) -> DataFrame:
    """Indicators and the attack patterns that `indicates` relationships tie to them. `stored` writes the objects' ids, so that bundles are made and parsed once, not
    for each side of the joins."""
    schema = "objects array<struct<type:string,id:string,relationship_type:string,source_ref:string,target_ref:string>>"
    o = bundles.select(F.explode(F.from_json(column, schema)["objects"]).alias("o")).select("o.*")
    o = o.filter("type in ('indicator', 'attack-pattern') or (type = 'relationship' and relationship_type = 'indicates')")
    o = stored(o) if stored else o
    links = o.filter("type = 'relationship' and relationship_type = 'indicates'").select(F.col("source_ref").alias("id"), F.col("target_ref").alias("target"))
    targets = o.filter("type = 'attack-pattern'").select(F.col("id").alias("target")).distinct()
    return o.filter("type = 'indicator'").select("id").distinct().join(links, "id").join(targets, "target").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))
