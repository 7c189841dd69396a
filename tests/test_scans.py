"""Scans over range partitions, sequences, peaks and causal orders against plain loops."""

import hashlib
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import integrity as I
from lakewarden.operators import joins as J
from lakewarden.operators import scans
from lakewarden.operators import search as S
from lakewarden.operators import windows as W


@pytest.fixture
def stored(spark, tmp_path):
    def write(df):
        at = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return write


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_average_and_variance_of_a_hot_key(spark, stored):
    pick = random.Random(1)
    rows = [("hot", i, pick.random() * 10) for i in range(700)] + [(f"k{i % 200}", i, float(i % 9)) for i in range(1200)] + [("one", 0, 2.5)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x double").withColumn("value2", F.lit(1))
    got = {(r.k, r.i): (r.ema, r.variance) for r in scans.ema_scan(df, "k", ["i"], "x", stored).collect()}
    assert len(got) == len(rows)
    by = {}
    for k, i, x in sorted(rows):
        ema, seen = by.get(k, (x, []))
        ema, seen = ema + 0.1 * (x - ema), [*seen, x][-20:]
        by[k] = (ema, seen)
        mean = sum(seen) / len(seen)
        assert math.isclose(got[(k, i)][0], ema, rel_tol=1e-9) and math.isclose(got[(k, i)][1], sum((v - mean) ** 2 for v in seen) / len(seen), rel_tol=1e-9, abs_tol=1e-12)
    assert scans.ema_scan(df.limit(0), "k", ["i"], "x", stored).count() == 0


def test_the_row_before_and_the_first_one(spark, stored):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i}", i, i * i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, x int")
    got = {r.i: (r.before and r.before.x, r.first.x) for r in scans.with_neighbours(df.repartition(5), ["k"], ["i"], ["x"], stored).collect()}
    last, first = {}, {}
    for k, i, x in rows:
        first.setdefault(k, x)
        assert got[i] == (last.get(k), first[k])
        last[k] = x


def test_drift_rules(spark, stored):
    flat, sharp, other = [0.25] * 4, [0.97, 0.01, 0.01, 0.01], [0.001, 0.001, 0.001, 0.997]
    sessions = {"a": [flat, flat, sharp], "b": [sharp, other, flat], "c": [flat, [0.05] * 5 + [0.75], flat], "d": [flat, flat], "e": [[1.0], flat, flat]}
    rows = [(s, 1, i, p) for s, ps in sessions.items() for i, p in enumerate(ps)]
    out = W.distribution_drift(spark.createDataFrame(rows, "s string, r int, i int, p array<double>"), "s", "r", "i", "p", stored)
    got = {(r.s, r.i): (r.alert, r.severity, r.collapse, r.saturated) for r in out.collect()}
    assert not [k for k in got if k[0] == "d"]  # under three tokens
    assert got[("a", 0)] == (None, None, False, None) and got[("a", 2)] == ("ENTROPY_COLLAPSE", "MEDIUM", True, False)
    assert got[("b", 1)][:2] == ("KL_SPIKE", "CRITICAL") and got[("b", 2)][0] == "KL_SPIKE"
    assert got[("c", 1)] == ("JS_SPIKE", "HIGH", False, True)  # weight where the one before has none: JS decides, and goes before drift
    assert got[("e", 1)] == ("JS_SPIKE", "HIGH", False, True) and got[("e", 2)] == ("SEMANTIC_DRIFT", "HIGH", False, False)
    summary = {r.s: (r.tokens, r.alerts, r.critical) for r in W.drift_responses(out, "s", "r").collect()}
    assert summary["a"] == (3, 1, 0) and summary["b"][2] >= 1 and "d" not in summary


FIELDS = "log string, seq long, chain_id string, chain_epoch long, local_seq long, node_hash string, local_prev_hash string, recorded_at string, prev_entry_hash string, entry_hash string"


def sealed(log, n, before=lambda i, r: None, after=lambda i, r: None):
    """A sequence sealed one entry after another; before and after change an entry before it is sealed or after."""
    rows, link, tips = [], "0" * 64, {}
    for i in range(1, n + 1):
        chain = f"c{i % 3}"
        at, node = tips.get(chain, (0, "0" * 64))
        r = {"seq": i, "chain_id": chain, "chain_epoch": i // 5, "local_seq": at + 1, "node_hash": sha(f"{log}{i}"), "local_prev_hash": node, "recorded_at": f"t\"{i}", "prev_entry_hash": link}
        before(i, r)
        r["entry_hash"] = link = sha(I.ENTRY_DOMAIN + json.dumps(r, sort_keys=True, separators=(",", ":")))
        tips[chain] = (r["local_seq"], r["node_hash"])
        rows.append(r)
    for i, r in enumerate(rows, 1):
        after(i, r)
    return [{"log": log, **r} for r in rows]


def at(k, **change):
    return lambda i, r: r.update({c: f(r[c]) for c, f in change.items()}) if i == k else None


def test_each_damage_of_a_sequence_is_found(spark, stored):
    up = lambda x: x + 1
    rows = sealed("good", 40) + sealed("altered", 40, after=at(9, node_hash=sha)) + sealed("link", 40, before=at(9, prev_entry_hash=sha)) + sealed("position", 40, before=at(9, local_seq=up))
    rows += sealed("chain", 40, before=at(9, local_prev_hash=sha)) + sealed("epoch", 40, before=at(9, chain_epoch=lambda x: -1)) + [r for r in sealed("gap", 40) if r["seq"] != 9] + [r for r in sealed("late", 40) if r["seq"] > 1]
    twice = sealed("twice", 40)
    rows += [*twice, twice[8]] + sealed("seal", 40, after=at(9, entry_hash=sha))
    df = spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in FIELDS.split(", ")) for r in rows], FIELDS)
    got = {r.log: (r.valid, r.error_seq, r.reason) for r in I.global_sequence_verify(df, "log", stored).collect()}
    assert got == {
        "good": (True, None, None), "altered": (False, 9, "entry altered"), "link": (False, 9, "broken link"), "position": (False, 9, "chain position skipped"), "chain": (False, 9, "chain link broken"),
        "epoch": (False, 9, "lease epoch went backwards"), "gap": (False, 10, "gap in seq"), "late": (False, 2, "gap in seq"), "twice": (False, 9, "gap in seq"), "seal": (False, 9, "entry altered"),
    }
    assert I.global_sequence_verify(df.limit(0), "log", stored).count() == 0


def plain_root(hashes, scheme):
    peaks = []
    for h in hashes:
        level = 0
        while peaks and peaks[-1][0] == level:
            left = peaks.pop()[1]
            h = sha(left + h) if scheme == 1 else sha(b"\x01" + bytes.fromhex(left) + bytes.fromhex(h))
            level += 1
        peaks.append((level, h))
    bag = "".join(h for _, h in peaks)
    return len(peaks), sha(bag) if scheme == 1 else sha(b"\x02" + bytes.fromhex(bag))


@pytest.mark.parametrize("scheme", [1, 2])
def test_appending_to_peaks_equals_rebuilding(spark, stored, scheme, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BITS", 3)  # many blocks, and blocks of blocks
    leaves = {log: [sha(f"{log}{i}") for i in range(n)] for log, n in (("a", 1), ("b", 7), ("c", 64), ("d", 333))}
    rows = [(log, 0, i, h) for log, own in leaves.items() for i, h in enumerate(own)]
    nodes = spark.createDataFrame(rows, "log string, level int, idx long, hash string").repartition(7)
    want = {log: (len(own), *plain_root(own, scheme)) for log, own in leaves.items()}
    roots = lambda peaks: {r.log: (r.n, r.peaks, r.root) for r in I.bag_root(peaks, "log", scheme).collect()}
    assert roots(I.mmr_bags(nodes, "log", scheme)) == want
    peaks = None
    for low, high in ((0, 5), (5, 70), (70, 1000)):
        new = nodes.filter((F.col("idx") >= low) & (F.col("idx") < high))
        peaks = stored(I.mmr_bags(new if peaks is None else peaks.unionByName(new), "log", scheme))
    assert roots(peaks) == want and peaks.count() == sum(w[1] for w in want.values())
    assert I.mmr_bags(nodes.limit(0), "log").count() == 0


def test_causal_order_holds_and_a_wrong_one_fails(spark, stored):
    pick, clocks, rows = random.Random(4), {r: {x: 0 for x in "abc"} for r in "abc"}, []
    for i in range(300):
        r = pick.choice("abc")
        if pick.random() < 0.3:  # hears of another
            other = clocks[pick.choice("abc")]
            clocks[r] = {x: max(clocks[r][x], other[x]) for x in "abc"}
        clocks[r][r] += 1
        rows.append((r, dict(clocks[r]), sha(str(i)), 1000 - i))
    df = spark.createDataFrame(rows, "replica string, clock map<string,int>, digest string, time int")
    keys, roots = ["clock_sum", "replica", "own", "digest"], set()
    for arrival in (df, df.repartition(6), df.orderBy("digest").unionByName(df)):
        log = I.causal_order(arrival.dropDuplicates(["digest"]), "clock")
        placed = stored(S.dense_position(log, keys, stored, 5))
        assert I.causal_violations(placed, "clock", "replica", "own", "position").count() == 0
        nodes = placed.select(F.lit("x").alias("log"), F.lit(0).alias("level"), F.col("position").alias("idx"), F.col("digest").alias("hash"))
        roots.add(I.bag_root(I.mmr_bags(nodes, "log"), "log").first().root)
    assert len(roots) == 1
    wrong = S.dense_position(I.causal_order(df, "clock"), ["time"], stored, 5)
    assert I.causal_violations(wrong, "clock", "replica", "own", "position").count() > 0


def test_a_receipt_is_one_row_whatever_the_replicas(spark, stored):
    leaves = spark.createDataFrame([("a", i, sha(str(i))) for i in range(6)], "log string, idx long, leaf_hash string")
    levels, sizes = I.mmr_levels(leaves, "log", stored), leaves.groupBy("log").agg(F.count("*").alias("n"))
    receipts = I.mmr_proofs(levels, sizes, leaves.select("log", "idx"), "log").join(leaves, ["log", "idx"])
    root = I.mmr_root(levels, sizes, "log").first().root
    roots = spark.createDataFrame([("r2", root), ("r1", root), ("r3", root), ("r0", sha("x"))], "replica string, root string")
    assert [r.replica for r in I.receipt_verify(receipts, roots, F.col("leaf_hash")).collect()] == ["r1"] * 6
    assert [r.replica for r in I.receipt_verify(receipts, roots, F.sha2("leaf_hash", 256)).collect()] == [None] * 6


def test_larger_tables_are_joined_without_a_broadcast(spark):
    prints = spark.createDataFrame([(i, i * 37) for i in range(30)], "id int, fingerprint long")
    centroids = spark.createDataFrame([(f"l{i}", i * 101) for i in range(9)], "label string, centroid long")
    few = J.cluster_match(prints, centroids).collect()
    at_most = J.bounded.__defaults__
    try:
        J.bounded.__defaults__ = (3,)
        assert sorted(map(tuple, J.cluster_match(prints, centroids).collect())) == sorted(map(tuple, few))
    finally:
        J.bounded.__defaults__ = at_most
