"""Boundary semantics of record checks, rankings and governance aggregates on small tables."""

from pyspark.sql import functions as F

from lakewarden.operators import joins as J
from lakewarden.operators import metrics as M
from lakewarden.operators import search as S
from lakewarden.operators import textjobs as X
from lakewarden.sources import formats as R


def test_record_checks(spark):
    good = (1, 0.5, 1.0, "committed", "allow", "a" * 64, "s0", "ab" * 32, None)
    change = lambda i, **x: tuple(x.get(c, v) for c, v in zip(("id", "score", "latency_ms", "status", "verdict", "digest", "signature_scheme", "signature", "public_key"), (i, *good[1:]), strict=True))
    rows = [
        good, change(2, score=float("nan")), change(3, score=float("-inf"), latency_ms=-0.1), change(4, status=None), change(5, verdict="ALLOW"), change(6, digest="A" * 64), change(7, digest=None), change(8, signature_scheme="s9"),
        change(9, signature="ab"), change(10, public_key="cd"), change(11, signature_scheme="s1", signature="ab", public_key=None), change(12, signature_scheme="s1", signature="ab", public_key="cd"), change(13, signature=None), change(14, score=None, latency_ms=None),
    ]
    df = spark.createDataFrame(rows, "id int, score double, latency_ms double, status string, verdict string, digest string, signature_scheme string, signature string, public_key string")
    schemes = spark.createDataFrame([("s0", 64, 0), ("s1", None, None)], "scheme string, signature_chars int, key_chars int")
    valid, bad = S.quarantine_invalid(S.signature_material(df, schemes), S.record_rules(["score"], digests=("digest",)))
    assert sorted(r.id for r in valid.collect()) == [1, 7, 12, 14]
    assert {r.id: list(r.reasons) for r in bad.collect()} == {2: ["non_finite"], 3: ["non_finite", "negative_latency"], 4: ["status"], 5: ["verdict"], 6: ["digest"], 8: ["scheme"], 9: ["material"], 10: ["material"], 11: ["material"], 13: ["material"]}


def test_hidden_phrases_in_three_forms(spark):
    rows = [(1, "please ig nore it"), (2, "say drop table now"), (3, "i-g n.o,re this"), (4, "ignore openly"), (5, None), (6, "ig"), (7, "")]
    got = {(r.id, r.phrase, r.form) for r in X.token_split_scan(spark.createDataFrame(rows, "id int, text string"), "id", "text", ["ignore", "drop table"]).collect()}
    assert got == {(1, "ignore", "bare"), (2, "drop table", "spaced"), (3, "ignore", "stripped")}


def test_times_and_texts_of_an_export(spark):
    rows = [(1, "1704067200000001", '"t1"'), (2, "2024-01-01T00:00:01Z", "7"), (3, "2024-13-01T00:00:00", '{"a":1}'), (4, "yesterday", None), (5, None, '"a\\"b"'), (6, "99999999999999999999", "x")]
    df = spark.createDataFrame(rows, "id int, t string, v string").select("id", R.time_of(F.col("t")).alias("t"), R.text_of(F.col("v")).alias("v"))
    got = {r.id: (r.t and r.t.isoformat(), r.v) for r in df.withColumn("t", F.col("t").cast("timestamp_ntz")).collect()}
    assert got == {1: ("2024-01-01T00:00:00.000001", "t1"), 2: ("2024-01-01T00:00:01", None), 3: (None, None), 4: (None, None), 5: (None, 'a"b'), 6: (None, None)}


def test_names_that_can_not_be(spark):
    rows = spark.createDataFrame([("a",), ("a-b_c.d",), ("",), ("a b",), ("-a",), (None,), ("x" * 65,), ("../etc",)], "org string")
    assert sorted(r.org for r in M.named_well(rows, "org").collect()) == ["a", "a-b_c.d"]


def test_whom_to_sync_with(spark):
    rows = spark.createDataFrame([("a", 5, "x"), ("b", 9, "y"), ("c", 9, "y"), ("d", 5, "z"), ("e", 7, None)], "replica string, n int, head string")
    got = {(r.a, r.b): (r.status, r.best) for r in J.replica_compare(rows).collect()}
    assert got[("a", "b")] == ("SYNC_NEEDED", True) and got[("a", "c")] == ("SYNC_NEEDED", False) and got[("a", "d")] == ("DIVERGED", False)
    assert got[("b", "c")] == ("NO_SYNC", False) and got[("b", "a")] == ("PEER_STALE", False) and got[("e", "a")][0] == got[("a", "e")][0] == "UNKNOWN"


def test_each_cluster_has_its_own_threshold(spark):
    prints = spark.createDataFrame([(1, 0b1), (2, 0b111), (3, 0b11110000)], "id int, fingerprint long")
    centroids = spark.createDataFrame([("near", 0, 2), ("far", 0b11111111, 4)], "label string, centroid long, threshold int")
    assert {r.id: (r.label, r.distance, r.matched) for r in J.cluster_match(prints, centroids).collect()} == {1: ("near", 1, True), 2: ("near", 3, False), 3: ("far", 4, True)}


def test_routing_against_a_calibrated_bound(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.3, 0.3, 0.3]), (3, [0.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [0.5]), (6, [0.0, 0.2, 0.2]), (7, [None, 0.1, 0.1])]
    v = spark.createDataFrame(rows, "id int, gates array<double>")
    bound = M.activation_bound(spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.2, 0.2, 0.6],)], "gates array<double>"), "gates", [1.0, 2.0, 3.0])
    assert abs(bound.first().bound - (1.5 + 0.99 * 0.9)) < 1e-9
    got = {r.id: (r.status, r.reasons) for r in M.routing_monitor(v, "id", "gates", [1.0, 2.0, 3.0], bound, 0.6).collect()}
    assert got == {1: ("NOMINAL", None), 2: ("ENTANGLEMENT_DETECTED", "distributed"), 3: ("CATASTROPHIC_ROUTING", None), 4: ("INVALID_INPUT", None), 5: ("INSUFFICIENT_DATA", None), 6: ("ENTANGLEMENT_DETECTED", "absolute,distributed"), 7: ("INVALID_INPUT", None)}
    nothing = M.activation_bound(v.limit(0), "gates", [1.0])
    assert M.routing_monitor(v.filter("id = 1"), "id", "gates", [1.0, 2.0, 3.0], nothing).first().status == "NOT_CALIBRATED"


def test_scorecard_counts_critical_bypasses(spark):
    rows = [("g", i, True, True, False) for i in range(99)] + [("g", 99, False, True, True), ("h", 0, True, True, True), ("h", 1, False, False, False)]
    s = spark.createDataFrame(rows, "by string, id int, blocked boolean, positive boolean, critical boolean")
    got = {r.by: (r.bypasses, r.critical_bypasses, r.passed) for r in M.detector_scorecard(s, "by", F.col("blocked"), F.col("positive"), F.col("critical")).collect()}
    assert got == {"g": (1, 1, False), "h": (0, 0, True)}


def test_tiers_and_integrity(spark):
    r = spark.createDataFrame([("c", "m0", "k1"), ("c", "m1", "k1"), ("c", "m1", "k2"), ("c", "zz", "k1"), ("d", "m0", "k1")], "chain string, scheme string, key string")
    schemes = spark.createDataFrame([("m0", 3, "PQC"), ("m1", 2, "ED25519")], "scheme string, rank int, tier string")
    got = {x.chain: (x.weakest, x.unsigned, x.n, x.tiers) for x in M.chain_assurance(r, "chain", schemes, "scheme", r.filter("key = 'k1'"), "key").collect()}
    assert got == {"c": ("UNSIGNED", 2, 4, "UNSIGNED:2,ED25519:1,PQC:1"), "d": ("PQC", 0, 1, "PQC:1")}
    cases = spark.createDataFrame([("a", "m", "s", "x", True, 0, True), ("a", "m", "s", "x", False, 2, None), ("b", "m", "s", "x", True, 0, False), ("c", "m", "s", "x", True, 0, True)], "case_id string, model string, session_id string, scheme string, allowed boolean, scrubbed int, intact boolean").withColumn("ts", F.lit(0))
    assert {r.case_id: (r.scrubbed, r.broken, r.integrity) for r in M.case_summary(cases, "case_id").collect()} == {"a": (1, 0, "UNKNOWN"), "b": (0, 1, "BROKEN"), "c": (0, 0, "INTACT")}
