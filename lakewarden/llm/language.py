"""Language identification: script ranges narrow the candidates of a word, Viterbi over per-word scores with a
switching penalty labels the spans of a text.

Training counts hashed byte n-grams (1 to 4, and whole words) of every language over all labelled texts; the
counts are summed by Spark, and the model - SLOTS numbers a language, whatever the corpus - goes to the tasks
as a broadcast variable. Texts are labelled one Arrow batch at a time, many texts side by side in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_most_in_a_batch, fresh, in_small_batches, named, table, trimmed

SLOTS = 1 << 16  # of the hashed n-gram table of each language
ORDERS = (1, 2, 3, 4)
PENALTY = 9.0  # nats that a change of language costs
CACHED = 200_000  # distinct words a task remembers before it starts anew
BLOCK = 750_000  # words that are labelled side by side
ROWS = 500  # texts that wait between the executor's heap and a task at a time
TOGETHER, TOGETHER_BYTES = 2_000, 1 << 24  # texts that are labelled side by side, as many as reach one of these
AT_ONCE = 10_000  # distinct words whose n-grams are taken at once

# Unicode ranges of scripts (name, first, last code point).
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF),
    ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF),
    ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
)
NAMES = tuple(dict.fromkeys(n for n, _, _ in SCRIPTS)) + ("other",)


def script_of(word: str) -> int:
    """The index in NAMES of the script of a word's first letter, -1 if it has none."""
    for ch in word:
        if ch.isalpha():
            cp = ord(ch)
            return next((NAMES.index(n) for n, a, b in SCRIPTS if a <= cp <= b), len(NAMES) - 1)
    return -1


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, word index) of every n-gram and whole word, over all words at once."""
    raw = [b"\x01" + w.encode("utf-8", "ignore") + b"\x01" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), sizes)
    slots, owners = [], []
    h = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(data) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                inside = owner[:m] == owner[n - 1 :]
                mixed = h[inside] ^ (h[inside] >> np.uint64(29))
                slots.append((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
                owners.append(owner[:m][inside])
        if len(raw):  # whole words
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            place = np.arange(len(data)) - np.repeat(starts, sizes)
            mixed = np.add.reduceat((data + np.uint64(257)) * np.power(np.uint64(0x100000001B3), (place + 1).astype(np.uint64)), starts)
            mixed ^= mixed >> np.uint64(31)
            slots.append((mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.int64))
            owners.append(np.arange(len(raw)))
    return (np.concatenate(slots), np.concatenate(owners)) if slots else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, slot, n) of a partition; slots below 0 count the letters of a script."""

    def flushed(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            keys, n = list(words), np.fromiter(words.values(), np.float64, len(words))
            total = np.zeros(SLOTS)
            for a in range(0, len(keys), AT_ONCE):
                slots, owners = ngrams(keys[a : a + AT_ONCE])
                total += np.bincount(slots, weights=n[a:][owners], minlength=SLOTS)
            scripts = Counter()
            for w, c in words.items():
                scripts[script_of(w)] += c * len(w)
            used = np.flatnonzero(total)
            ids = list(used) + [-1 - s for s in scripts if s >= 0]
            values = list(total[used]) + [float(c) for s, c in scripts.items() if s >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(values, pa.float64())], ["lang", "slot", "n"])

    seen: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            seen.setdefault(lang.as_py(), Counter()).update(text.as_py().lower().split())
            if sum(map(len, seen.values())) > CACHED:
                yield from flushed(seen)
                seen = {}
    yield from flushed(seen)


def together(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches, one after another put together until they have so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class LanguageModel:
    """Scores of words by language: languages, log-probabilities (SLOTS + 1, languages), scripts (NAMES, languages); common: the language with most
    n-grams, the first of equals."""

    def __init__(self, languages: list[str], logp: np.ndarray, scripts: np.ndarray, common: int = 0):
        self.languages, self.logp, self.scripts, self.common = languages, logp, scripts, common

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores less the best language's, letters, letters with a vote) of each word; 0 for all languages and no
        vote if it has no letter or its script is of none."""
        if len(words) > AT_ONCE:
            parts = [self.scores(words[a : a + AT_ONCE]) for a in range(0, len(words), AT_ONCE)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        slots, owners = ngrams(words)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, weights=self.logp[slots, k], minlength=len(words)) / len(ORDERS)
        letters, script = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for i, w in enumerate(words):
            if (s := script_of(w)) >= 0:
                script[i], letters[i] = s, sum(map(str.isalpha, w))
        allowed = self.scripts[script]
        out[~allowed] = -1e4
        out -= out.max(axis=1, keepdims=True)
        unknown = (script < 0) | ~allowed.any(axis=1)
        out[unknown] = 0
        return np.maximum(out, -12.0), letters, np.where(unknown, 0, letters)


class Words(dict):
    """Numbers words in the order they come; `new` has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def viterbi(texts: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """The best language of every word of each text (arrays of word numbers), texts side by side.

    The penalty is one for all changes, so a step needs the best score before it alone."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    offsets = np.concatenate(([0], np.cumsum(active)))
    packed = np.empty(int(offsets[-1]), np.int32)
    for row, i in enumerate(order):
        packed[offsets[: len(texts[i])] + row] = texts[i]
    stay = np.empty((len(packed), scores.shape[1]), bool)
    best = np.empty(len(packed), np.int8 if scores.shape[1] < 128 else np.int32)
    labels = np.empty(len(packed), best.dtype)
    v = np.zeros((len(order), scores.shape[1]), np.float32)
    final = np.empty(len(order), best.dtype)
    for t in range(steps):
        n, at = active[t], slice(offsets[t], offsets[t + 1])
        if n < len(v):
            final[n : len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        top = v.max(axis=1, keepdims=True) - np.float32(penalty)
        stay[at] = v >= top
        best[at] = v.argmax(axis=1)
        v = np.maximum(v, top) + scores[packed[at]]
        v -= v.max(axis=1, keepdims=True)
    final[: len(v)] = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n, at = active[t], slice(offsets[t], offsets[t + 1])
        now = final[:n]
        labels[at] = now
        kept = np.take_along_axis(stay[at], now[:, None].astype(np.int64), axis=1)[:, 0]
        final[:n] = np.where(kept, now, best[at])
    out: list[np.ndarray] = [labels[:0]] * len(texts)
    for row, i in enumerate(order):
        out[i] = labels[offsets[: len(texts[i])] + row]
    return out


@in_small_batches
def train_language_model(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, script_share: float = 0.001) -> LanguageModel:
    """Learn from every row of df whose text and language are not null.

    What comes to the driver are at most SLOTS numbers a language. No such row: a model of no language."""
    labelled = df.select(named(df, text_col).alias("text"), named(df, lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = labelled.mapInArrow(trimmed(_count), "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(counts["lang"].unique())
    grown = np.zeros(max(1, len(languages)))
    logp, scripts = np.zeros((SLOTS, max(1, len(languages)))), np.zeros((len(NAMES) + 1, max(1, len(languages))), bool)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grams, letters = own[own["slot"] >= 0], own[own["slot"] < 0]
        logp[grams["slot"], k] = grams["n"]
        grown[k] = grams["n"].sum()
        logp[:, k] = np.log((logp[:, k] + smoothing) / (logp[:, k].sum() + smoothing * SLOTS))
        share = letters["n"] / max(1.0, letters["n"].sum())
        scripts[-1 - letters["slot"][share >= script_share], k] = True
    return LanguageModel(languages, logp, scripts, int(grown.argmax()))


def label_languages(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """The language spans of every text of df.

    Returns the columns named in keep and lang_pred (of the most letters; `und` if the text is null or has no
    letter; the commonest language, with score 0, if all letters are of scripts that no language has), score (that language's share of all letters, 0 to 1; letters of
    other scripts are of no language) and spans
    (first and last word, 0-based, and language). One row for each input row; whole texts, however long; an empty
    table gives an empty result. Where a kept column has the name of a result column, the latter gets
    underscores at its end. A text without blanks, as of Chinese or Thai, is one word. From here on the session hands ROWS rows at
    most to a Python task at a time.
    """
    keep = keep or []
    at_most_in_a_batch(df.sparkSession, ROWS)
    made = [fresh(name, keep) for name in ("lang_pred", "score", "spans")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*[named(df, k) for k in keep], named(df, text_col).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL("a string, b double, c array<struct<first:int,last:int,lang:string>>").fields])
    for field, name in zip(schema.fields[-3:], made, strict=True):
        field.name = name
    schema.names = [f.name for f in schema.fields]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = shared.value
        words, scores, letters, voting = Words(), np.zeros((0, max(1, len(m.languages))), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
        for batch in together(batches, TOGETHER, TOGETHER_BYTES):
            texts = batch.column(batch.num_columns - 1)
            n = batch.num_rows
            lang, score, spans = ["und"] * n, [0.0] * n, [[]] * n
            # longest first, so that texts side by side are of about one length
            order = sorted(range(n), key=lambda i: -len(texts[i].as_py() or "")) if m.languages else []
            at = 0
            while at < len(order):
                if len(words) > CACHED:
                    words, scores, letters, voting = Words(), scores[:0], letters[:0], voting[:0]
                ids, rows, size = [], [], 0
                while at < len(order) and size < BLOCK:
                    tokens = (texts[order[at]].as_py() or "").lower().split()
                    ids.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                    rows.append(order[at])
                    size, at = size + len(tokens), at + 1
                if words.new:
                    new = m.scores(words.new)
                    words.new = []
                    scores, letters, voting = (np.concatenate(pair) for pair in zip((scores, letters, voting), new, strict=True))
                for row, own, labels in zip(rows, ids, viterbi(ids, scores, penalty), strict=True):
                    votes = np.bincount(labels, weights=voting[own], minlength=1)
                    if not votes.any() and letters[own].any():  # letters, but of no learned script
                        lang[row] = m.languages[m.common]
                    if votes.any():
                        lang[row] = m.languages[int(votes.argmax())]
                        score[row] = float(votes.max() / letters[own].sum())
                        cuts = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1))
                        ends = [*cuts[1:], len(labels)]
                        spans[row] = [{"first": int(a), "last": int(b) - 1, "lang": m.languages[int(labels[a])]} for a, b in zip(cuts, ends, strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))]
            out = pa.RecordBatch.from_arrays(columns, [*keep, *made])
            yield from (out.slice(a, ROWS) for a in range(0, n, ROWS))

    return source.mapInArrow(trimmed(label), schema)


def held_out(id_col: Column, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder by 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == rest


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter(~held_out(F.col("doc_id"), 0)))
    out = label_languages(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
