"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.textjobs import lsh_bands
from .states import BUCKETS, state_store


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is (availableNow) into a Parquet sink under `checkpoint` and read that.

    In update mode each micro-batch adds its rows with its number, a repeated one replaces its own, and the latest row of
    every one of `keys` is returned."""
    spark = stream.sparkSession
    at, log = f"{checkpoint}/{name}/out", f"{checkpoint}/{name}/log"
    if mode == "append":
        with state_store(spark):
            running = stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", log).trigger(availableNow=True).start()
        running.awaitTermination()
        return spark.read.schema(stream.schema).parquet(at)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/_batch={number}")

    with state_store(spark):
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(at)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("_last")).select(*keys, "_last.*")


def dedup(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once, of deliveries at most `delay` apart."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, keys: list[str], ts: str, length: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_errors(events: DataFrame, ts: str, length: str, step: str, delay: str) -> DataFrame:
    agg = events.withWatermark(ts, delay).groupBy(F.window(ts, length, step)).agg(F.count("*").alias("n"), F.count_if(F.col("status_class") == "5xx").alias("errors"))
    return agg.select(F.col("window.start").alias("start"), "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("ratio"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    agg = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return agg.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def correlate(events: DataFrame, fingerprint: str, tenant: str, ts: str, length: str, delay: str, tenants: int) -> DataFrame:
    """Templates (equal fingerprints) that several tenants send in one window; streaming has no exact distinct."""
    agg = events.withWatermark(ts, delay).groupBy(F.window(ts, length), fingerprint).agg(F.approx_count_distinct(tenant, 0.02).alias("tenants"), F.count("*").alias("n"))
    return agg.filter(F.col("tenants") >= tenants).select(F.col("window.start").alias("start"), fingerprint, "tenants", "n")


COMPARED = 1 << 20  # pairs of fingerprints compared at a time


def near_observations(prints: DataFrame, again: DataFrame, *, look_back_s: int = 3600, distance: int = 8, delay: str = "1 hour", bands: int = 8) -> DataFrame:
    """Observations (id, tenant, ts, fingerprint) of a stream beside those of the same stream, read `again`, that came before within the look-back and whose
    fingerprint shares a band and differs in `distance` bits at most: (id, band, otenant, oid, ots), the row itself among them. Rows without an id or a time meet nothing.

    Rows of one band and value are kept together, `bands` x 256 groups with the default bands, and compared in blocks: the work grows with the square of the rows within the look-back, but
    a pair costs a few nanoseconds in place of a row of a join. Both sides have a watermark, `delay` behind the latest row, and state of either side ends once nothing can
    meet it, with the micro-batch after. Rows later than that meet nothing."""
    span = look_back_s * 1_000_000

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        held = pickle.loads(state.get[0]) if state.exists else None
        came = None if state.hasTimedOut else pd.concat([f[["earlier", "at", "fingerprint", "id", "tenant"]] for f in frames])
        if came is not None:
            came = came[came["at"] >= now]
            came = {side: came.loc[came["earlier"] == side, ["at", "fingerprint", "id", "tenant"]] for side in (False, True)}
            met = [(came[False], came[True])] if held is None else [(came[False], held[True]), (held[False], came[True]), (came[False], came[True])]
            for new, old in met:
                for pairs in _near(new, old, span, distance):
                    yield pd.DataFrame({"id": pairs[0], "band": k[0], "otenant": pairs[1], "oid": pairs[2], "ots": pairs[3]})
            held = came if held is None else {side: pd.concat([held[side], came[side]]) for side in (False, True)}
        # later rows of one side are not behind the watermark, so an earlier one of `prints` meets none, and one of `again` only those within the look-back
        held = {side: rows[rows["at"] + (span if side else 0) >= now] for side, rows in held.items()}
        if len(held[False]) + len(held[True]):
            state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max([now // 1000, 1, *[int(rows["at"].max() + (span if side else 0)) // 1000 for side, rows in held.items() if len(rows)]]))
        elif state.exists:
            state.remove()

    def dealt(rows: DataFrame, earlier: bool) -> DataFrame:
        rows = lsh_bands(rows.filter("fingerprint <> 0 and id is not null and ts is not null").withWatermark("ts", delay), bands)
        return rows.select("band", "band_value", F.lit(earlier).alias("earlier"), F.unix_micros("ts").alias("at"), "fingerprint", "id", "tenant", "ts")

    kind = lambda c: _kind(prints, c)
    both = dealt(prints, False).unionByName(dealt(again, True))
    told = f"id {kind('id')}, band int, otenant {kind('tenant')}, oid {kind('id')}, ots long"
    return both.groupBy("band", "band_value").applyInPandasWithState(update, told, "held binary", "append", "EventTimeTimeout").withColumn("ots", F.timestamp_micros("ots"))


def _near(new: pd.DataFrame, old: pd.DataFrame, span: int, distance: int) -> Iterator[tuple]:
    """Arrays (id, tenant of the earlier, its id, its time) of the pairs of two frames that are near in bits and time, a block at a time."""
    if not len(new) or not len(old):
        return
    mine, theirs = (f["fingerprint"].to_numpy(np.int64) for f in (new, old))
    (at, ids), (oat, oids, tenants) = (new[c].to_numpy() for c in ("at", "id")), (old[c].to_numpy() for c in ("at", "id", "tenant"))
    block = max(1, COMPARED // len(theirs))
    for a in range(0, len(mine), block):
        i, j = np.nonzero(np.bitwise_count((mine[a : a + block, None] ^ theirs).view(np.uint64)) <= distance)
        i += a
        kept = (oat[j] >= at[i] - span) & ((oat[j] < at[i]) | ((oat[j] == at[i]) & (oids[j] <= ids[i])))
        i, j = i[kept], j[kept]
        if len(i):
            yield ids[i], tenants[j], oids[j], oat[j]


def correlated(met: DataFrame, checkpoint: str, name: str, tenants: int = 3) -> DataFrame:
    """Run near_observations to the end and tell the observations, by band, whose template `tenants` different tenants sent: id, band, n_tenants,
    tenants, n_seen, first_seen.

    Each micro-batch writes its meetings under its number, a repeated one in place of its own; distinct tenants are counted exactly over what all
    batches wrote of the observations. Within a stream no exact distinct count exists."""
    spark = met.sparkSession
    at = f"{checkpoint}/{name}/met"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/_batch={number}")

    with state_store(spark):
        running = met.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(met.schema).parquet(f"{at}/_batch=*")
    found = rows.groupBy("id", "band").agg(F.count_distinct("otenant").alias("n_tenants"), F.array_join(F.sort_array(F.collect_set("otenant")), ",").alias("tenants"), F.count_distinct("oid").alias("n_seen"), F.min("ots").alias("first_seen"))
    return found.filter(F.col("n_tenants") >= tenants)


def _kept(chunks: DataFrame, stream: str, start: Callable, end: Callable, out_type: str, idle: str | None, buckets: int) -> DataFrame:
    """Rows (stream, then out_type) that `end` tells of streams of chunks (seq, chunk, last, ts), whose states are start()'s lists: [latest, held chunks by seq, seq of the
    last chunk or -1, ...]. end(state) -> (whether the stream has ended, rows to tell), once in each micro-batch that has chunks of the stream.

    The states of a bucket of streams are one value of Spark's, as a call and a frame for each of many short streams cost more than their chunks do. Each stream
    still ends by itself: its state is dropped when it has ended, or when the watermark is `idle` past its latest row and the micro-batch has none of it."""
    span = None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta("1ms"))
    names = [stream, *StructType.fromDDL(out_type).names]

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streams = pickle.loads(state.get[0]) if state.exists else {}
        met: dict = {}
        for frame in frames if not state.hasTimedOut else ():
            for name, seq, chunk, last, at in zip(*[frame[c].tolist() for c in ("stream", "seq", "chunk", "last", "at")], strict=True):
                own = met.get(name)
                if own is None:
                    own = met[name] = streams.pop(name, None) or start()
                own[1][seq] = chunk
                if last and seq > own[2]:
                    own[2] = seq
                if at > own[0]:
                    own[0] = at
        if span is not None:
            now = state.getCurrentWatermarkMs()
            streams = {name: own for name, own in streams.items() if own[0] + span >= now}
        out = []
        for name, own in met.items():
            ended, told = end(own)
            out += [(name, *t) for t in told]
            if not ended:
                streams[name] = own
        if streams:
            state.update((pickle.dumps(streams),))
            if span is not None:
                state.setTimeoutTimestamp(max(min(own[0] for own in streams.values()) + span, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    kind = _kind(chunks, stream)
    at = F.unix_millis("ts") if idle else F.lit(0).cast("long")
    rows = chunks.select(F.pmod(F.xxhash64(stream), F.lit(buckets)).alias("bucket"), F.col(stream).cast("string").alias("stream"), "seq", "chunk", "last", at.alias("at"), *(["ts"] if idle else []))
    told = rows.groupBy("bucket").applyInPandasWithState(update, f"{stream} string, {out_type}", "streams binary", "append", "EventTimeTimeout" if idle else "NoTimeout")
    return told.withColumn(stream, F.col(stream).cast(kind))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def summary(chunks: DataFrame, stream: str, idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Chunks, bytes and the digest of each stream once its last chunk (column `last`) is there and none before it is missing.

    State of a stream: its chunks so far, in order of seq whatever order they come in; dropped when the watermark
    is `idle` past its last row, if that is given (events need a watermark then)."""

    def end(state: list) -> tuple[bool, list[tuple]]:
        _, held, last = state
        if last < 0 or len(held) <= last:
            return False, []
        text = "".join(held[i] for i in range(last + 1)).encode()
        return True, [(last + 1, len(text), hashlib.sha256(text).hexdigest())]

    return _kept(chunks, stream, lambda: [0, {}, -1], end, "chunks long, bytes long, digest string", idle, buckets)


def _by_key(rows: DataFrame, key: list[str], order: list[str], partitions: int) -> DataFrame:
    return rows.repartition(partitions, *key).sortWithinPartitions(*key, *order)


def rate_limit_replay(requests: DataFrame, key: str, per_s: float, burst: int, partitions: int = 200) -> DataFrame:
    """Which requests a GCRA limiter would admit: sequential within a key.

    After `burst` intervals without a request a limiter's state is that of a new key. So a key is split where a whole stretch of
    that length is empty: the stretches with requests are counted, and runs of them are replayed apart. Rows pass
    in the order of time through a task in Arrow batches, so a busy key needs no more memory than others."""
    interval = 1.0 / per_s
    stretch = burst * interval

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tat = None, 0.0
        for frame in frames:
            admitted = []
            for k, part, now in zip(frame["key"], frame["part"], frame["at"], strict=True):
                if (k, part) != current:
                    current, tat = (k, part), now
                new = max(tat, now) + interval
                ok = new - burst * interval <= now + 1e-9
                admitted.append(ok)
                tat = new if ok else tat
            yield frame[["key", "request_id"]].assign(admitted=admitted)

    rows = requests.select(F.col(key).alias("key"), "request_id", (F.unix_micros("ts") / 1e6).alias("at")).withColumn("bucket", F.floor(F.col("at") / stretch))
    w = Window.partitionBy("key").orderBy("bucket")
    busy = rows.groupBy("key", "bucket").agg(F.count("*").alias("n")).withColumn("starts", (F.col("bucket") - F.coalesce(F.lag("bucket").over(w), F.col("bucket") - 2) > 1).cast("int"))
    parts = busy.withColumn("part", F.sum("starts").over(w)).select("key", "bucket", "part")
    dealt = _by_key(rows.join(parts, ["key", "bucket"]), ["key", "part"], ["at", "request_id"], partitions)
    return dealt.select("key", "part", "request_id", "at").mapInPandas(replay, f"key {_kind(rows, 'key')}, request_id long, admitted boolean").withColumnRenamed("key", key)


def outage_episodes(requests: DataFrame, key: str, threshold: int = 5, cool_s: float = 30.0, successes: int = 2, partitions: int = 200) -> DataFrame:
    """Episodes of a circuit breaker replayed over each key's outcomes: opened, closed (null if still open), failures.

    Rows of a key pass in the order of time through a task in Arrow batches: its memory does not grow with them."""

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, run, good, opened, failures, since = None, "closed", 0, 0, None, 0, 0.0
        for frame in frames:
            out = []
            for k, at, failed in zip(frame["key"], frame["at"], frame["failed"], strict=True):
                if k != current:
                    if opened is not None:
                        out.append((current, opened, None, failures))
                    current, state, run, good, opened, failures, since = k, "closed", 0, 0, None, 0, 0.0
                if state == "open" and at - since >= cool_s:
                    state, good = "half", 0
                if failed:
                    failures += 1
                    run += 1
                    if state == "half" or (state == "closed" and run >= threshold):
                        opened = at if opened is None else opened
                        state, since = "open", at
                else:
                    run = 0
                    if state == "half":
                        good += 1
                        if good >= successes:
                            out.append((k, opened, at, failures))
                            state, opened = "closed", None
                    if state == "closed":
                        failures = 0
            yield pd.DataFrame(out, columns=["key", "opened", "closed", "failures"])
        if opened is not None:
            yield pd.DataFrame([(current, opened, None, failures)], columns=["key", "opened", "closed", "failures"])

    rows = requests.select(F.col(key).alias("key"), "request_id", (F.unix_micros("ts") / 1e6).alias("at"), (F.col("status_class") == "5xx").alias("failed"))
    return _by_key(rows, ["key"], ["at", "request_id"], partitions).mapInPandas(replay, f"key {_kind(rows, 'key')}, opened double, closed double, failures long").withColumnRenamed("key", key)


def redact_chunks(chunks: DataFrame, stream: str, redact, hold: int = 64, idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Redacted pieces (stream, part, text) of each stream as its chunks come: what is settled is released, cut after a line
    break with at least `hold` characters behind it, and the rest with the last chunk (column `last`). Redaction must not
    reach over line breaks.

    State of a stream: the next seq, chunks that came too early, the text held back, the number of pieces released;
    dropped when the watermark is `idle` past its last row, if given."""

    def end(state: list) -> tuple[bool, list[tuple]]:
        _, held, last, after, pending, part = state
        came = [pending]
        while after in held:
            came.append(held.pop(after))
            after += 1
        pending, out = "".join(came), []
        done = 0 <= last < after
        cut = len(pending) if done else pending.rfind("\n", 0, max(0, len(pending) - hold)) + 1
        if cut or done:
            out.append((part, redact(pending[:cut])))
            pending, part = pending[cut:], part + 1
        state[3:] = after, pending, part
        return done, out

    return _kept(chunks, stream, lambda: [0, {}, -1, 0, "", 0], end, "part long, text string", idle, buckets)
