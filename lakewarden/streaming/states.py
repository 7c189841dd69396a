"""Keyed state that ends: rows of a key folded in the order of event time.

The rows of a key wait until the watermark has passed them, so they are folded in order however they arrive, in whatever micro-batch. What is folded ends `idle` after the
key's last row: a later row of the key begins anew, and what nothing came for is dropped. Rows behind the watermark are dropped. Held for a key: its rows within the watermark's
delay and those of a micro-batch, and its folded values.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, NumericType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which these need, and checkpoint what a micro-batch changed instead of RocksDB's own files, which it writes anew as it
    merges them; the session is left as it was."""
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, CHANGES)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(CHANGES, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


BUCKETS = 1024  # of keys whose states are kept together


def _micros(idle: str | None) -> int | None:
    return None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta("1us"))


def folded(events: DataFrame, key: str, ts: str, columns: list[str], start: tuple, fold: Callable, out_type: str, *, idle: str | None, mode: str = "append", tell: Callable | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows that a fold tells of each key's events (columns, in the order of ts, then of the columns), state ending `idle` after a key's last row.
    events: a stream with a watermark on ts. fold(state, row) -> (state, rows to tell), over rows (micros, then the columns), from `start`. tell: also told after each fold of
    ready rows, from the state. Rows without a time are left out.

    The states of a bucket of keys are one value of Spark's, as calls and timers for each of many keys cost far more than folding their rows. Each key's state still ends by
    itself: a bucket is taken up in each micro-batch that has rows of it, and when the watermark passes the first of its rows that wait or the end of its first state."""
    span, names = _micros(idle), [key, *StructType.fromDDL(out_type).names]

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        waiting, states = pickle.loads(state.get[0]) if state.exists else ({}, {})
        for frame in () if state.hasTimedOut else frames:
            values = [frame[f"c{i}"].tolist() for i in range(len(columns))]
            for row, nulls in [(i, n) for i, n in enumerate(frame["nulls"].tolist()) if n]:
                for i, column in enumerate(values):
                    if nulls >> i & 1:
                        column[row] = None
            for name, row in zip(frame["key"].tolist(), zip(frame["at"].tolist(), *values, strict=True), strict=True):
                if row[0] >= now:
                    waiting.setdefault(name, []).append(row)
        out = []
        for name, rows in list(waiting.items()):
            ready = sorted(r for r in rows if r[0] <= now)
            if not ready:
                continue
            if len(ready) < len(rows):
                waiting[name] = [r for r in rows if r[0] > now]
            else:
                del waiting[name]
            last, values = states.get(name, (None, start))
            for row in ready:
                if last is not None and span is not None and row[0] - last > span:
                    values = start
                values, told = fold(values, row)
                out += [(name, *t) for t in told]
                last = row[0]
            if tell:
                out += [(name, *t) for t in tell(values)]
            states[name] = (last, values)
        if span is not None:
            states = {name: own for name, own in states.items() if own[0] + span >= now}
        if waiting or states:
            state.update((pickle.dumps((waiting, states), pickle.HIGHEST_PROTOCOL),))
            # the last millisecond at which a bucket may still be left alone
            ends = [-(-min(r[0] for r in rows) // 1000) - 1 for rows in waiting.values()] + ([(own[0] + span) // 1000 for own in states.values()] if span is not None else [])
            if ends:
                state.setTimeoutTimestamp(max(min(ends), now // 1000, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    kinds = events.select(*columns).schema
    # a null would turn its column's numbers into doubles on the way: it travels as a bit
    plain = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) if isinstance(f.dataType, NumericType | BooleanType) else F.col(f.name) for f in kinds]
    nulls = sum((F.col(f.name).isNull().cast("long") * (1 << i) for i, f in enumerate(kinds)), F.lit(0).cast("long"))
    rows = events.filter(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at"), *[c.alias(f"c{i}") for i, c in enumerate(plain)], nulls.alias("nulls"), ts
    )  # the time itself is there for the watermark
    kind = events.schema[key].dataType.simpleString()
    told = rows.groupBy("bucket").applyInPandasWithState(update, f"{key} string, {out_type}", "states binary", mode, "EventTimeTimeout")
    return told.withColumn(key, F.col(key).cast(kind))


def session_states(events: DataFrame, key: str, ts: str = "ts", *, window: int = 10, limit: float = 2.0, streak: int = 3, idle: str | None = "1 day") -> DataFrame:
    """Escalations: (key, request_id, rule) of rows where the last `window` scores sum to `limit` (window_score) or `streak` soft hits (score above 0 and
    allowed) stand in a row (streak); the first rule that holds is told."""

    def fold(state: tuple, row: tuple) -> tuple:
        last, run = state
        _, request, score, allowed = row
        last = [*last, score][-window:]
        run = run + 1 if score > 0 and allowed else 0
        rule = "window_score" if round(sum(last), 6) >= limit else "streak" if run >= streak else None
        return (last, run), [(request, rule)] if rule else []

    return folded(events, key, ts, ["request_id", "waf_score", "allowed"], ([], 0), fold, "request_id long, rule string", idle=idle)


def ema_updates(events: DataFrame, key: str, value: str, tie: str, ts: str = "ts", *, alpha: float = 0.1, idle: str | None = "1 day") -> DataFrame:
    """Running average and variance (exponentially weighted) of each key since its state began: (key, n, ema, variance), told whenever rows were folded."""

    def fold(state: tuple, row: tuple) -> tuple:
        n, ema, variance = state
        step = row[2] - ema
        ema, variance = (row[2], 0.0) if n == 0 else (ema + alpha * step, (1 - alpha) * (variance + alpha * step * step))
        return (n + 1, ema, variance), []

    rows = events.withColumn("value_", F.col(value).cast("double"))
    return folded(rows, key, ts, [tie, "value_"], (0, 0.0, 0.0), fold, "n long, ema double, variance double", idle=idle, mode="update", tell=lambda s: [s])


def erosion_states(events: DataFrame, key: str, value: str, score: str, tie: str, ts: str = "ts", *, drop: float = 0.8, decline: int = 4, baseline: int = 3, window: int = 10, idle: str | None = "1 day") -> DataFrame:
    """Erosion of a value in a conversation: (key, turn, fall, declining, rule) of rows where a rule holds. The value declines strictly for `decline` rows
    (decline), or the mean of the last three is `drop` below that of the first `baseline` (drop; half of it where the last `window` scores sum to 0.5)."""

    def fold(state: tuple, row: tuple) -> tuple:
        first, last, run, scores = state
        _, turn, v, s = row
        first = [*first, v] if len(first) < baseline else first
        run = run + 1 if last and v < last[-1] else 1
        n, last, scores = len(last) + 1, [*last, v][-3:], [*scores, s][-window:]
        fall = round(sum(first) / len(first) - sum(last) / len(last), 6)
        rule = "decline" if n > 1 and run >= decline else "drop" if n > 1 and fall >= (drop / 2 if round(sum(scores), 6) >= 0.5 else drop) else None
        return (first, last, run, scores), [(turn, fall, min(run, window), rule)] if rule else []

    rows = events.withColumn("value_", F.col(value).cast("double")).withColumn("score_", F.col(score).cast("double"))
    return folded(rows, key, ts, [tie, "value_", "score_"], ([], [], 0, []), fold, "turn long, fall double, declining long, rule string", idle=idle)


OUTCOMES = "outcome string, chunks long, bytes long, tokens long, elapsed_s double, digest string"
BLANKS = r"(?U)[\s\x{1C}-\x{1F}]+"  # what Python's split takes for white space


def _outcome(rows: list[tuple], most_bytes: int | None, most_event_bytes: int | None) -> tuple:
    """How a stream's chunks (at, seq, kind, size, words, digest), in order, came to its end."""
    n, size, words, digest, first, now = 0, 0, 0, "0" * 64, rows[0][0], rows[0][0]
    told = lambda outcome: (outcome, n, size, words, (now - first) / 1e6, digest)
    for now, seq, kind, more, some, own in rows:
        if kind == "disconnect":
            return told("client_disconnected")
        if kind == "error":
            return told("upstream_error")
        if most_event_bytes is not None and more > most_event_bytes:
            return told("event_limit")
        if most_bytes is not None and size + more > most_bytes:
            return told("byte_limit")
        digest = hashlib.sha256((digest + own.hex()).encode()).hexdigest()
        n, size, words = n + 1, size + more, words + some
        if kind == "last":
            return told("complete" if n == seq + 1 else "upstream_incomplete")
    return told("timeout")


class Outcomes(StatefulProcessor):
    """The chunks of a bucket of streams, appended a block for each micro-batch and read when the first stream of them may have ended."""

    def __init__(self, names: list[str], idle: int, most_bytes: int | None, most_event_bytes: int | None):
        self.names, self.idle, self.most_bytes, self.most_event_bytes = names, idle, most_bytes, most_event_bytes

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "block binary")
        self.settled = handle.getValueState("settled", "at long")  # streams that had ended by then are told

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            frame = frame[frame["at"] + self.idle >= now].sort_values(["stream", "at"])
            if len(frame):
                self.blocks.appendValue((_block([frame[c].tolist() for c in ("stream", "at", "seq", "kind", "size", "words", "digest")]),))
                first = min(first or int(frame["at"].min()), int(frame["at"].min()))
        if first is not None:
            self.handle.registerTimer(-(-(first + self.idle) // 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before = self.settled.get()
        before = before[0] if before else -1
        if before >= now:
            return
        streams: dict = {}
        for (block,) in self.blocks.get():
            for name, *row in zip(*_columns(block), strict=True):
                streams.setdefault(name, []).append(tuple(row))
        out, open_, ended = [], [], 0
        for name, rows in streams.items():
            rows.sort()
            starts = [0, *[i for i in range(1, len(rows)) if rows[i][0] - rows[i - 1][0] > self.idle], len(rows)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if rows[b - 1][0] + self.idle >= now:
                    open_.append((name, rows[a:b]))
                    continue
                ended += b - a
                if rows[b - 1][0] + self.idle >= before:
                    out.append((name, *_outcome(rows[a:b], self.most_bytes, self.most_event_bytes)))
        left = sum(len(rows) for _, rows in open_)
        if not left:
            self.blocks.clear()
        elif ended >= left:  # so that a row is written anew once for each other that goes
            self.blocks.put([(_block([list(c) for c in zip(*[(name, *r) for name, rows in open_ for r in rows], strict=True)]),)])
        self.settled.update((now,))
        if left:
            self.handle.registerTimer(-(-(min(rows[-1][0] for _, rows in open_) + self.idle) // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _block(columns: list[list]) -> bytes:
    """Columns stream, at, seq, kind, size, words, digest in few bytes."""
    names, at, seq, kind, size, words, digest = columns
    numbers = [np.array(c, np.int64).tobytes() for c in (at, seq, size, words)]
    return zlib.compress(pickle.dumps((names, kind, numbers, b"".join(digest)), pickle.HIGHEST_PROTOCOL), 1)


def _columns(block: bytes) -> list[list]:
    names, kind, numbers, digest = pickle.loads(zlib.decompress(block))
    at, seq, size, words = (np.frombuffer(c, np.int64).tolist() for c in numbers)
    return [names, at, seq, kind, size, words, [digest[i : i + 32] for i in range(0, len(digest), 32)]]


def stream_outcomes(chunks: DataFrame, stream: str, ts: str = "ts", *, idle: str = "10 minutes", most_bytes: int | None = None, most_event_bytes: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """How each stream of chunks (stream, seq from 0, chunk, kind: chunk, last, disconnect or error) came to its end, once: outcome, chunks, bytes, tokens (words), elapsed_s (from
    its first chunk), digest.

    complete: its last chunk came and none before is missing, else upstream_incomplete; client_disconnected and upstream_error: it said so; byte_limit: its bytes would exceed
    `most_bytes`; event_limit: a chunk does exceed `most_event_bytes` (that chunk counts for neither); timeout: nothing came for `idle` without an end. What comes after the end, within
    `idle`, is passed over; a stream that comes again later is a new one. Chunks are taken in the order of time, then seq. The digest is of digests: each chunk's SHA-256 is
    hashed onto that of those before (of nothing: 64 zeros), so state holds no text.

    A stream is told once the watermark has passed `idle` after its last chunk. State holds each chunk's time, seq, kind, size, words and digest until then, by bucket of streams: what a
    micro-batch brings is added to a bucket, and what is there is only written anew when at least half of it has ended."""
    c = F.coalesce(F.col("chunk"), F.lit(""))
    words = F.size(F.filter(F.split(c, BLANKS, -1), lambda w: w != "")).cast("long")
    numbers = [F.unix_micros(ts).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), F.octet_length(c).cast("long").alias("size"), words.alias("words")]
    rows = chunks.filter(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(stream), F.lit(buckets)).alias("bucket"), F.col(stream).cast("string").alias("stream"), F.coalesce("kind", F.lit("")).alias("kind"), *numbers, F.unhex(F.sha2(c, 256)).alias("digest"), ts
    )  # the time itself is there for the watermark
    schema = StructType.fromDDL(f"{stream} string, {OUTCOMES}")
    told = rows.groupBy("bucket").transformWithStateInPandas(Outcomes(schema.names, _micros(idle), most_bytes, most_event_bytes), schema, "append", "EventTime")
    return told.withColumn(stream, F.col(stream).cast(chunks.schema[stream].dataType))
