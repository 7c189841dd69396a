"""Hidden Markov language model: Baum-Welch on every training text, exact likelihoods by the scaled forward recursion.

The hidden states emit word classes: each of the HEAD most frequent training words is a class of its own, every
other word belongs to one of TAILS classes by its last bytes, the end of a text is a class. Within a class a word has
its share of the class's training count (add-half smoothed, one place for words never seen), whatever the
state. So the model's tables - states times classes - have a fixed size and go to the tasks as broadcast variables,
while the counts of all words stay a Spark table that only the rarer words of each text are joined with. With one
state the model is the smoothed unigram model; what it gains comes from the states.

Counting, expectation and scoring run in tasks over Arrow batches; Spark sums counts over partitions. The encoded
texts are written once in the shared folder.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, stored, table
from .language import held_out

HEAD, TAILS = 8191, 8192  # classes of one word each; classes by word ending
CLASSES = 1 + HEAD + TAILS
STATES, ROUNDS = 8, 6
HALF = 0.5  # added to every count
PRIOR = 100.0  # weight of the class frequencies in each state's emissions
BLOCK = 400_000  # words side by side
CACHED = 400_000  # distinct words counted before a task passes them on


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and the controls from tab to carriage return."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tail_class(word: bytes) -> int:
    return 1 + HEAD + zlib.crc32(word[-3:]) % TAILS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > CACHED:
                yield batch_of(counts)
                counts = Counter()
    yield batch_of(counts)


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and number of words of each tail class in a partition of the word table."""
    c, v = np.zeros(CLASSES), np.zeros(CLASSES, np.int64)
    for batch in batches:
        classes = np.fromiter((tail_class(w.as_py()) for w in batch.column(0)), np.int64, batch.num_rows)
        c += np.bincount(classes, weights=batch.column(1).to_numpy(), minlength=CLASSES)
        v += np.bincount(classes, minlength=CLASSES)
    used = np.flatnonzero(v)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(c[used], pa.float64()), pa.array(v[used], pa.int64())], ["class", "c", "v"])


def _encoded(head):
    """Class numbers of every text and its words outside the head with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i + 1 for i, w in enumerate(head.value)}
        for batch in batches:
            ids, tails, counts = [], [], []
            for text in batch.column(batch.num_columns - 1):
                words = words_of(text.as_py())
                own = [known.get(w, -1) for w in words]
                rest: Counter = Counter()
                for i, k in enumerate(own):
                    if k < 0:
                        own[i] = tail_class(words[i])
                        rest[words[i]] += 1
                ids.append(np.array([*own, 0], np.uint16).tobytes())
                tails.append(list(rest))
                counts.append(list(rest.values()))
            made = [pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + made, ["rid", "id", "learn", "ids", "tails", "tail_counts"])

    return run


class Packed:
    """Texts side by side: at step t the texts longer than t, longest first, in one run of the packed arrays."""

    def __init__(self, texts: list[np.ndarray]):
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in self.order])
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), side="left")
        self.offsets = np.concatenate(([0], np.cumsum(self.active))).astype(np.int64)
        self.ids = np.empty(int(self.offsets[-1]), np.int64)
        for row, i in enumerate(self.order):
            self.ids[self.offsets[: len(texts[i])] + row] = texts[i]

    def at(self, t: int) -> slice:
        return slice(self.offsets[t], self.offsets[t + 1])


class HiddenMarkov:
    """start (K), move (K, K) and emit (classes, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 likelihood of each text's classes."""
        p, out = Packed(texts), np.zeros(len(texts))
        e, a = self.emit[p.ids], None
        for t in range(p.steps):
            a = (self.start if a is None else a[: p.active[t]] @ self.move) * e[p.at(t)]
            scale = a.sum(axis=1)
            out[: p.active[t]] += np.log10(scale)
            a /= scale[:, None]
        back = np.empty(len(texts))
        back[p.order] = out
        return back

    def expected(self, texts: list[np.ndarray], emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """Add the texts' expected counts."""
        p = Packed(texts)
        e = self.emit[p.ids].astype(np.float32)
        move, start = self.move.astype(np.float32), self.start.astype(np.float32)
        alpha, scales = np.empty_like(e), np.empty(len(e), np.float32)
        a, ones = None, np.ones(len(move), np.float32)
        for t in range(p.steps):
            at = p.at(t)
            a = (start if a is None else a[: p.active[t]] @ move) * e[at]
            scale = a @ ones
            a = a / scale[:, None]
            alpha[at], scales[at] = a, scale
        e /= scales[:, None]
        gamma, b, total = alpha, np.ones((0, len(move)), np.float32), np.zeros_like(move)
        for t in range(p.steps - 1, -1, -1):
            at, n = p.at(t), p.active[t]
            if len(b) < n:  # texts that end here
                b = np.concatenate((b, np.ones((n - len(b), len(move)), np.float32)))
            ahead = e[at] * b
            if t:
                total += alpha[p.at(t - 1)][:n].T @ ahead
            gamma[at] *= b
            b = ahead @ move.T
        moved += total * move
        if p.steps:
            started += gamma[p.at(0)].sum(axis=0)
        for k in range(len(move)):
            emitted[:, k] += np.bincount(p.ids, weights=gamma[:, k], minlength=CLASSES)


def _blocks(column: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The texts of a batch, longest first, in blocks of texts of about one length: (their rows, their classes)."""
    texts = [np.frombuffer(x.as_py(), np.uint16) for x in column]
    block, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        block.append(i)
        size += len(texts[i])
        if size >= BLOCK:
            yield block, [texts[i] for i in block]
            block, size = [], 0
    if block:
        yield block, [texts[i] for i in block]


def _expectation(shared, states: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for _, block in _blocks(batch.column(0)):
                shared.value.expected(block, emitted, moved, started)
        used = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate((used, -1 - np.arange(states), [-1 - states]))
        rows = np.concatenate((emitted[used], moved, started[None, :]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32())] + [pa.array(rows[:, k]) for k in range(states)], ["key"] + [f"s{k}" for k in range(states)])

    return run


def _scored(shared, within, base, trained: bool):
    """rid, id, learn, tokens, known head tokens, their base score, and the log10 likelihood of the classes less that of
    the tail classes' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, totals, head = shared.value, within.value, base.value
        for batch in batches:
            n = batch.num_rows
            tokens, known, sums, likely = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for rows, block in _blocks(batch.column(3)):
                likely[rows] = hmm.log10(block) - np.array([totals[x].sum() for x in block])
                tokens[rows] = [len(x) for x in block]
                known[rows] = [int((x <= HEAD).sum()) if trained else 0 for x in block]
                sums[rows] = [float(head[x].sum()) for x in block]
            made = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(likely, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], ["rid", "id", "learn", "n_tokens", "head_known", "head_log10", "classes_log10"])

    return run


def first_guess(frequency: np.ndarray, states: int) -> HiddenMarkov:
    """Sticky states whose emissions are the class frequencies, each moved by a seeded random factor."""
    noise = np.random.default_rng(5).gamma(1.0, size=(CLASSES, states)) + 0.2
    emit = frequency[:, None] * noise
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    return HiddenMarkov(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def baum_welch(encoded: DataFrame, frequency: np.ndarray, *, states: int = STATES, rounds: int = ROUNDS) -> HiddenMarkov:
    """Each round one pass over the column `ids`; what comes to the driver are CLASSES + states + 1 rows."""
    spark = encoded.sparkSession
    hmm = first_guess(frequency, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(hmm)
        schema = "key int, " + ", ".join(f"s{k} double" for k in range(states))
        sums = encoded.select("ids").mapInArrow(_expectation(shared, states), schema).groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toPandas()
        keys, rows = sums["key"].to_numpy(), sums[[f"s{k}" for k in range(states)]].to_numpy()
        emitted, moved, started = np.zeros((CLASSES, states)), np.zeros((states, states)), np.zeros(states)
        emitted[keys[keys >= 0]] = rows[keys >= 0]
        for key, row in zip(keys, rows, strict=True):
            if key == -1 - states:
                started = row
            elif key < 0:
                moved[-1 - key] = row
        emitted += PRIOR * frequency[:, None]
        moved += 1.0
        started = started + 1.0
        hmm = HiddenMarkov(started / started.sum(), moved / moved.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
        shared.unpersist()
    return hmm


def score_texts(df: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows of df where learn holds and score all.

    Returns id, learned, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (smoothed unigram) and score (the model), log10 probabilities of whole texts; one row for each
    input row. Null and blank texts are their end token alone. Repeated rows are scored each. Without training rows every
    token is unknown. An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("rid"), named(df, id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), named(df, text_col).alias("text"))
    words = stored(docs.filter("learn").select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    top = words.orderBy(F.desc("c"), "word").limit(HEAD).collect()  # HEAD rows at most
    head, head_counts = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64)
    shared_head = spark.sparkContext.broadcast(head)
    encoded = stored(docs.mapInArrow(_encoded(shared_head), f"rid long, id {docs.schema['id'].dataType.simpleString()}, learn boolean, ids binary, tails array<binary>, tail_counts array<int>"), "encoded")

    totals = words.agg(F.sum("c"), F.count("*")).first()
    texts = encoded.filter("learn").count()
    n, v = (totals[0] or 0) + texts, totals[1] + (1 if texts else 0)
    kept = words.join(F.broadcast(spark.createDataFrame([(w,) for w in head], "word binary")), "word", "left_anti")  # HEAD rows
    tails = kept.mapInArrow(_classed, "class int, c double, v long").groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    class_totals = np.zeros(CLASSES)
    class_totals[0], class_totals[1 : 1 + len(head)] = texts + HALF, head_counts + HALF
    class_totals[1 + HEAD :] = HALF
    class_totals[tails["class"]] = tails["c"] + HALF * (tails["v"] + 1)
    frequency = class_totals / class_totals.sum()
    hmm = baum_welch(encoded.filter("learn"), frequency, states=states, rounds=rounds)

    within = np.zeros(CLASSES)
    within[1 + HEAD :] = np.log10(class_totals[1 + HEAD :])
    denominator = float(np.log10(n + HALF * (v + 1)))
    head_base = np.zeros(CLASSES)
    head_base[0], head_base[1 : 1 + len(head)] = np.log10(texts + HALF), np.log10(head_counts + HALF)
    give = spark.sparkContext.broadcast
    schema = f"rid long, id {docs.schema['id'].dataType.simpleString()}, learn boolean, n_tokens long, head_known long, head_log10 double, classes_log10 double"
    scored = encoded.select("rid", "id", "learn", "ids").mapInArrow(_scored(give(hmm), give(within), give(head_base), bool(texts)), schema)
    rare = encoded.select("rid", F.explode(F.arrays_zip("tails", "tail_counts")).alias("t")).select("rid", F.col("t.tails").alias("word"), F.col("t.tail_counts").alias("tf"))
    rare = rare.join(words, "word", "left").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + HALF)).alias("tail_log10"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"))
    out = scored.join(rare, "rid", "left")
    tail = F.coalesce("tail_log10", F.lit(0.0))
    return out.select(
        "rid", "id", F.col("learn").alias("learned"), "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log10") + tail - F.col("n_tokens") * F.lit(denominator)).alias("base_score"), (F.col("classes_log10") + tail).alias("score"),
    )


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, ~held_out(F.col("doc_id"), 1))
    return out.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
