"""Streams whose keyed state ends, and meetings of near fingerprints: order, lateness, expiry, exact tenants."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import joins as J
from lakewarden.plans import catalog
from lakewarden.streaming import jobs as B
from lakewarden.streaming import states as ST

END = "2030-01-01 00:00:00"


def stream(spark, at, batches, schema, delay="1 hour"):
    """Each batch one file and one micro-batch, in this order; the last row lets the watermark pass the others."""
    for rows in batches:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(at))
        kept = df.schema
    rows = spark.readStream.schema(kept).option("maxFilesPerTrigger", 1).parquet(str(at))
    return rows.withWatermark("ts", delay) if delay else rows


REQUESTS = "session_id string, request_id long, waf_score double, allowed boolean, ts string"


def test_a_session_that_returns_begins_anew(spark, tmp_path):
    day = lambda d, h: f"2024-01-0{d} 0{h}:00:00"
    first = [("a", 1, 0.9, True, day(1, 1)), ("a", 2, 0.9, True, day(1, 2)), ("b", 10, 0.9, True, day(1, 1))]
    later = [("a", 3, 0.9, True, day(4, 1)), ("b", 11, 0.9, True, day(1, 3))]  # a came back after two days, b goes on
    more = [("a", 4, 0.9, True, day(4, 2)), ("a", 5, 0.9, True, day(4, 3)), ("b", 12, 0.9, True, day(1, 3))]
    s = stream(spark, tmp_path / "in", [first, later, more, [("z", 0, 0.0, True, END)]], REQUESTS)
    got = B.drained(ST.session_states(s, "session_id", idle="1 day"), "states", "append", str(tmp_path)).collect()
    found = {(r.session_id, r.request_id, r.rule) for r in got}
    assert ("a", 5, "window_score") in found and not {("a", 3, "streak"), ("a", 3, "window_score"), ("a", 4, "streak")} & found
    assert not [f for f in found if f[1] == 12 and f[0] == "b"]  # behind the watermark when it came
    on = stream(spark, tmp_path / "in2", [first, later, more, [("z", 0, 0.0, True, END)]], REQUESTS)
    for_ever = {(r.session_id, r.request_id) for r in B.drained(ST.session_states(on, "session_id", idle=None), "states2", "append", str(tmp_path)).collect()}
    assert ("a", 3) in for_ever


def test_averages_do_not_depend_on_arrival(spark, tmp_path):
    pick = random.Random(3)
    rows = [("k", i, float(pick.randrange(100)), f"2024-01-01 00:{i:02d}:00") for i in range(40)] + [("l", 99, 5.0, "2024-01-01 00:10:00")]
    want, ema = None, 0.0
    for _, _, x, _ in rows[:40]:
        ema = x if want is None else ema + 0.1 * (x - ema)
        want = ema
    for n, shuffled in enumerate((rows, pick.sample(rows, len(rows)))):
        s = stream(spark, tmp_path / f"in{n}", [shuffled[:15], [*shuffled[15:], ("k", 100, 0.0, END)]], "k string, request_id long, x double, ts string")
        got = {r.k: r for r in B.drained(ST.ema_updates(s, "k", "x", "request_id"), f"ema{n}", "update", str(tmp_path), ["k"]).collect()}
        assert got["k"].n == 40 and got["k"].ema == pytest.approx(want) and got["l"].n == 1 and "z" not in got


def test_each_stream_ends_once(spark, tmp_path):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    minute = lambda m: f"2024-01-01 00:{m:02d}:00"
    first = [("done", 0, "one two", "chunk", minute(0)), ("gone", 0, "x", "chunk", minute(0)), ("left", 0, "x", "chunk", minute(0)), ("bad", 0, "x", "chunk", minute(0)), ("big", 0, "x" * 8, "chunk", minute(0)), ("wide", 0, "x" * 11, "chunk", minute(0)), ("hole", 0, "x", "chunk", minute(0))]
    later = [("done", 1, " drei", "last", minute(2)), ("left", 1, None, "disconnect", minute(1)), ("bad", 1, None, "error", minute(1)), ("big", 1, "y" * 8, "chunk", minute(1)), ("big", 2, "z", "last", minute(2)), ("hole", 2, "z", "last", minute(1)), ("done", 2, "after", "chunk", minute(3)), ("empty", 0, None, "last", minute(3))]
    again = [("gone", 0, "back", "last", minute(50))]
    batches = [first, later, again, [("z", 0, "", "chunk", END)]]
    s = stream(spark, tmp_path / "in", batches, "stream string, seq long, chunk string, kind string, ts string")
    got = sorted((r.stream, r.outcome, r.chunks, r.bytes, r.tokens, r.elapsed_s) for r in B.drained(ST.stream_outcomes(s, "stream", idle="10 minutes", most_bytes=12, most_event_bytes=10), "out", "append", str(tmp_path)).collect())
    assert got == [
        ("bad", "upstream_error", 1, 1, 1, 60.0), ("big", "byte_limit", 1, 8, 1, 60.0), ("done", "complete", 2, 12, 3, 120.0), ("empty", "complete", 1, 0, 0, 0.0), ("gone", "complete", 1, 4, 1, 0.0),
        ("gone", "timeout", 1, 1, 1, 0.0), ("hole", "upstream_incomplete", 2, 2, 2, 60.0), ("left", "client_disconnected", 1, 1, 1, 60.0), ("wide", "event_limit", 0, 0, 0, 0.0),
    ]
    digests = {r.stream: r.digest for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()}
    assert digests["done"] == sha(sha("0" * 64 + sha("one two")) + sha(" drei")) and digests["wide"] == "0" * 64


def test_the_session_is_left_as_it_was(spark):
    before = spark.conf.get(ST.PROVIDER, None)
    with ST.state_store(spark):
        assert spark.conf.get(ST.PROVIDER) == ST.ROCKS
    assert spark.conf.get(ST.PROVIDER, None) == before


PRINTS = "id long, tenant string, fingerprint long, ts string"


def observations(seed, n):
    pick = random.Random(seed)
    base = [pick.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(n):
        fp = base[pick.randrange(6)]
        for bit in pick.sample(range(63), pick.randrange(10)):
            fp ^= 1 << bit
        at = pick.randrange(5 * 3600)
        rows.append((i, f"t{pick.randrange(5)}", fp, f"2024-01-01 {at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}"))
    return rows


def brute_meetings(rows, tenants=3):
    """(id, band) -> tenants, seen, first, by looking at all pairs."""
    seconds = lambda t: int(t[11:13]) * 3600 + int(t[14:16]) * 60 + int(t[17:])
    out = {}
    for i, _, f, t in rows:
        for band in range(8):
            met = [(o, x) for o, x, g, s in rows if f >> 8 * band & 255 == g >> 8 * band & 255 and bin(f ^ g).count("1") <= 8 and (s < t or (s == t and o <= i)) and seconds(t) - seconds(s) <= 3600]
            if len({x for _, x in met}) >= tenants:
                out[(i, band)] = (",".join(sorted({x for _, x in met})), len({o for o, _ in met}))
    return out


def told(df):
    return {(r.id, r.band): (r.tenants, r.n_seen) for r in df.collect()}


def test_near_observations_meet_in_a_stream(spark, tmp_path):
    rows = sorted(observations(1, 90), key=lambda r: r[3])
    batches = [rows[:30], rows[30:60], rows[60:], [(999, "z", 1, END)]]
    new, old = (stream(spark, tmp_path / x, batches, PRINTS, None) for x in ("new", "old"))
    got = told(B.correlated(B.near_observations(new, old, delay="6 hours"), str(tmp_path), "near"))
    assert got == brute_meetings(rows) and got
    # a row far behind the watermark meets nothing, as the state of the others has ended
    late = [(500, "t9", rows[0][2], rows[0][3])]
    new, old = (stream(spark, tmp_path / x, [rows[:30], rows[30:], [(997, "z", 1, "2024-01-03 00:00:00")], [(998, "z", 1, "2024-01-03 01:00:00")], late, [(999, "z", 1, END)]], PRINTS, None) for x in ("new2", "old2"))
    assert told(B.correlated(B.near_observations(new, old, delay="6 hours"), str(tmp_path), "late")) == brute_meetings(rows)


def test_correlation_equals_all_pairs(spark):
    rows = observations(2, 300) + [(1000 + i, f"t{i % 7}", 12345, f"2024-01-01 02:{i % 60:02d}:00") for i in range(200)]
    df = spark.createDataFrame(rows, PRINTS).withColumn("ts", F.col("ts").cast("timestamp"))
    got = told(J.xsession_correlate(df))
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:], r)  # equal observations of a tenant at one time are one
    assert got == brute_meetings(list(first.values()))


def test_streams_of_one_bucket_end_by_themselves(spark, tmp_path):
    """Summaries and redacted pieces of many streams whose states are kept together: one that ends late, one that is idle, one without a name."""
    schema = "s long, seq long, chunk string, last boolean, t long"
    batches = [
        [(1, 0, "a", False, 0), (2, 0, "b", False, 0), (None, 0, "n", False, 1)],
        [(2**60 + 1, 0, "é", True, 100), (1, 2, "c", True, 100)],
        [(None, 1, "m", True, 101), (1, 1, "b", False, 150), (3, 0, "z", False, 5000)],
        [(4, 0, "never ends", False, 5000)],
        [(2, 1, "l", True, 5001), (3, 1, "y", True, 5001)],
        [(9, 0, "end", False, 9000)],
    ]
    at = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(at)
    rows = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at).withColumn("ts", F.timestamp_seconds(F.col("t") + 1000))
    told = lambda df, name: B.drained(df, name, "append", str(tmp_path / "out")).collect()
    whole = {1: "abc", None: "nm", 2**60 + 1: "é", 3: "zy"}
    got = {r.s: (r.chunks, r.bytes, r.digest) for r in told(B.summary(rows(), "s", buckets=1), "plain")}
    assert got == {k: (len(v), len(v.encode()), hashlib.sha256(v.encode()).hexdigest()) for k, v in (whole | {2: "bl"}).items()}
    timed = {r.s for r in told(B.summary(rows().withWatermark("ts", "1 second"), "s", idle="10 minutes", buckets=1), "timed")}
    assert timed == set(whole)  # the first chunk of 2 was dropped 10 minutes after it
    pieces = {}
    for r in sorted(told(B.redact_chunks(rows(), "s", str.upper, buckets=1), "pieces"), key=lambda r: r.part):
        pieces[r.s] = pieces.get(r.s, "") + r.text
    assert pieces == {k: v.upper() for k, v in (whole | {2: "bl"}).items()}


def test_a_micro_batch_has_many_files(spark):
    """Rows of a stream are written and read by several tasks a micro-batch, all of a time before all of the next; few rows by one."""
    from lakewarden.plans.integrity_queries import _stream

    def batches(df, cuts=None):
        seen, stream = {}, _stream(spark, df, cuts)
        write = lambda b, i: seen.update({i: b.withColumn("file", F.input_file_name()).agg(F.count("*"), F.min("ts"), F.max("ts"), F.count_distinct("file")).first()})
        stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{catalog._folder(spark)}/log").start().awaitTermination()
        return [seen[i] for i in sorted(seen)]

    rows = spark.range(700_000).select("id", F.timestamp_seconds(F.col("id") % 9999).alias("ts"))
    got = batches(rows)
    assert sum(b[0] for b in got) == 700_000 and len(got) == 3 and all(b[3] == got[0][3] > 1 for b in got)
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
    few = batches(rows.filter("id < 50"))
    assert sum(b[0] for b in few) == 50 and all(b[3] == 1 for b in few)
    late = F.col("id") % 2 == 0
    halves = batches(rows, [late, ~late])
    assert [b[0] for b in halves] == [350_000, 350_000] and all(b[3] > 1 for b in halves)
    assert sum(b[0] for b in batches(rows.limit(0))) == 0


def test_keys_of_one_bucket_are_folded_by_themselves(spark, tmp_path):
    """Many keys whose states are kept together: rows out of order, late ones, keys that come back after `idle`, one without a name, numbers that a double can't hold, beside nulls."""
    pick, big = random.Random(7), 2**60 + 1
    keys, hour = ["a", "b", "c", None, "long ago"], 3_600
    rows = [(pick.choice(keys[:4]), big + i if i % 9 else None, float(pick.randrange(9)), pick.randrange(2, 200) * hour // 4 + i) for i in range(160)] + [("long ago", big, 1.0, 5)]
    rows.sort(key=lambda r: r[3] + pick.randrange(hour))  # as they arrive, at most an hour late
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    batches = [*batches, [("a", 1, 1.0, 0)], [("z", 0, 0.0, 10**9)]]  # a row far behind the watermark, and the end
    for b in batches:
        spark.createDataFrame(b, "k string, request_id long, x double, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, request_id long, x double, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = s.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "2 hours")
    seen = lambda state, row: ((*state, row[2]), [(row[1], len(state) + 1)])
    df = ST.folded(s, "k", "ts", ["request_id", "x"], (), seen, "request_id long, n long", idle="3 hours", buckets=1)
    got = sorted(((r.k or "", r.request_id or 0, r.n) for r in B.drained(df, "many", "append", str(tmp_path)).collect()))
    want, last = [], {}
    for k, request, _, t in sorted(rows, key=lambda r: r[3]):
        before, n = last.get(k, (t, 0))
        last[k] = (t, n + 1 if t - before <= 3 * hour else 1)
        want.append((k or "", request or 0, last[k][1]))
    assert got == sorted(want) and max(n for _, _, n in want) > 3 and [w for w in want if w[2] == 1 and w[0] == "a"][1:]


def test_many_keys_have_few_states(spark, tmp_path):
    """3,000 sessions, each a state and timers of its own before: calls for each of them in every micro-batch took nearly all of the time."""
    rows = [(f"s{i % 3000}", i, 0.9, True, f"2024-01-01 0{i // 3000}:00:00") for i in range(9000)]
    s = stream(spark, tmp_path / "in", [rows[:3000], rows[3000:6000], [*rows[6000:], ("z", 0, 0.0, True, END)]], REQUESTS)
    told = []
    with ST.state_store(spark):
        q = ST.session_states(s, "session_id").writeStream.foreachBatch(lambda b, i: told.append(b.count())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(told) == 3000  # the third soft hit of each
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 1024


def test_chunks_are_added_to_state_not_written_anew(spark, tmp_path):
    """Streams whose chunks come in many micro-batches: each chunk's state is written about once, where all of a stream's were written again with each of its micro-batches."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(k, s, f"chunk {k} {s}", "last" if s == 239 else "chunk", at(s)) for k in range(60) for s in range(b * 20, b * 20 + 20)] for b in range(12)]
    batches[3] += [(None, 0, "no name", "chunk", at(61)), (None, None, None, None, at(62)), (7000, 0, "a", "chunk", at(5)), (7000, 1, "b", "last", "2024-01-01 01:00:00")]
    s = stream(spark, tmp_path / "in", [*batches, [(9999, 0, "", "chunk", END)]], "stream long, seq long, chunk string, kind string, ts string", "2 hours")
    got = sorted(((-1 if r.stream is None else r.stream), r.outcome, r.chunks, r.elapsed_s) for r in B.drained(ST.stream_outcomes(s, "stream"), "out", "append", str(tmp_path)).collect())
    assert got == [(-1, "timeout", 2, 1.0), *[(k, "complete", 240, 239.0) for k in range(60)], (7000, "timeout", 1, 0.0), (7000, "upstream_incomplete", 1, 0.0)]
    assert sum(f.stat().st_size for f in (tmp_path / "out" / "log" / "state").rglob("*") if f.is_file()) < 4_000_000


def test_near_observations_are_kept_by_band_and_value(spark, tmp_path):
    """Rows of one band and value are one state and compared in blocks, where each row was 24 rows of a join's state and each pair of a band a row of it. Rows without an id, tenant or print."""
    rows = sorted(observations(5, 300), key=lambda r: r[3])
    batches = [rows[:150], [*rows[150:], (None, "t1", rows[150][2], rows[150][3]), (700, "t1", None, rows[150][3]), (701, "t1", 0, rows[150][3])], [(999, "z", 1, END)]]
    new, old = (stream(spark, tmp_path / x, batches, PRINTS, None) for x in ("new", "old"))
    met = []
    with ST.state_store(spark):
        q = B.near_observations(new, old, delay="6 hours").writeStream.foreachBatch(lambda b, i: met.extend(b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in met:
        if r.id != 999:
            got.setdefault((r.id, r.band), []).append((r.otenant, r.oid))
    assert {k: (",".join(sorted({t for t, _ in v})), len(v)) for k, v in got.items()} == brute_meetings(rows, 1)
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 8 * 256
