"""Packing by lexical retrieval: token windows filled with a seed document and its nearest unused neighbours by BM25.

1. Texts become token ids (a closing id ends each document), written once.
2. Document frequencies of all token ids are counted over all documents; the table has as many rows as the vocabulary, which
   bounds what comes to the driver and is broadcast.
3. Whole windows of long documents stand for themselves. What remains of each document, under a window, is the index's entry. Entries
   are range-sorted by their two rarest terms that another document has, so that related ones are side by side, and a
   frequent pair of terms spreads over partitions by row.
4. Stretches of entries in this order are the shards of the inverted index, bounded in tokens and entries. In a shard the first
   unused entry is the seed of a window; the index returns the unused entries in the order of their scores and these fill the window; the
   last is cut, and its rest is the next seed. A window that a shard leaves open is filled by the next one, and the last of a partition is
   cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, partitions, stored, table

WINDOW = 1024
END = 0  # closes each document
K1, B = 1.2, 0.75  # of BM25
SHARD_TOKENS, SHARD_ENTRIES = 1 << 17, 4096
FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")  # a tokenizer, and its vocabulary as ranks
ROWS = 256  # of a batch that is handed on


class Vocabulary:
    """A tokenizer on a task, and the same vocabulary as ranks, which is three times as fast and gives the same ids but for the tokenizer's special
    strings; texts with one of these go to the tokenizer. files: (tokenizer, ranks), paths or files of public_tokenizers."""

    def __init__(self, files: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        json, ranks = (f if os.path.isabs(f) else public_tokenizers.path(f) for f in files)
        self.whole = Tokenizer.from_file(json)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made, special_tokens={})
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, with the closing id."""
        ids = self.whole.encode(text, add_special_tokens=False).ids if any(s in text for s in self.special) else self.ranks.encode_ordinary(text)
        return np.array([*ids, END], self.kind)


@lru_cache(2)
def vocabulary(files: tuple[str, str]) -> Vocabulary:
    return Vocabulary(files)


TOKENS = "_row long, doc_id {id}, ids binary, n long, _pid int, _at long"


def _tokenize(files: tuple[str, str], window: int):
    """(_row, doc_id, text, _pid) -> ids with the closing id (16 bits each where that is enough, else 32), their number, and how many whole windows the
    partition's documents before it have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = vocabulary(files), 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids = [made.encode(text.as_py() or "") for text in part.column(2)]
                ats = []
                for own in ids:
                    ats.append(at)
                    at += len(own) // window
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([own.tobytes() for own in ids], pa.binary()), pa.array(map(len, ids), pa.int64()), part.column(3), pa.array(ats, pa.int64())], names=["_row", "doc_id", "ids", "n", "_pid", "_at"])

    return run


def _unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, documents that have it) of a partition."""
    seen = np.zeros(1 << 16, np.int64)
    place, number = np.zeros(1 << 16, np.int64), np.arange(1 << 12)
    for batch in batches:
        for raw, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            ids = _unpacked(raw.as_py(), n)
            if ids.dtype.itemsize > 2 and int(ids.max()) >= len(seen):
                more = np.zeros(int(ids.max()) + (1 << 16) - len(seen), np.int64)
                seen, place = np.append(seen, more), np.append(place, more)
            if n > len(number):
                number = np.arange(2 * n)
            place[ids] = number[:n]
            seen[ids[place[ids] == number[:n]]] += 1  # the last place of each
    tokens = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(seen[tokens], pa.int64())], names=["token", "df"])


class Statistics:
    """What BM25 needs of the whole corpus: documents, the mean length of entries, and the documents that have a token. rarity: the tokens in
    the order of their documents, those of one document last."""

    def __init__(self, documents: int, mean_length: float, df: np.ndarray):
        self.mean_length = max(mean_length, 1.0)
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        self.rarity = np.empty(len(df), np.int64)
        self.rarity[np.lexsort((np.arange(len(df)), df, df < 2))] = np.arange(len(df))

    def weights(self, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / self.mean_length))


def _entries(window: int, statistics):
    """What remains of each document beyond whole windows, with its two rarest terms that another document has (as their ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = statistics.value.rarity
        for batch in batches:
            rows = [(i, raw.as_py(), k) for i, (raw, k) in enumerate(zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True)) if k % window]
            ids = [_unpacked(raw, k)[k - k % window :] for _, raw, k in rows]
            if not rows:
                continue
            sizes = np.array([len(x) for x in ids])
            rank, starts = rarity[np.concatenate(ids)], np.cumsum(sizes) - sizes
            first = np.minimum.reduceat(rank, starts)
            second = np.minimum.reduceat(np.where(rank == np.repeat(first, sizes), len(rarity), rank), starts)
            part = batch.take(pa.array([i for i, _, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), part.column("n"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["_row", "doc_id", "n", "ids", "_t1", "_t2"])

    return run


class Shard:
    """A BM25 inverted index over some entries, each a numpy array of token ids. A term's postings are entries and weights."""

    def __init__(self, entries: list[np.ndarray], statistics: Statistics):
        sizes = np.array([len(e) for e in entries])
        wide = len(statistics.idf)
        pairs, tf = np.unique(np.repeat(np.arange(len(entries)), sizes) * wide + np.concatenate(entries), return_counts=True)
        entry, terms = pairs // wide, pairs % wide
        _, self.term_of = np.unique(terms, return_inverse=True)
        self.first = np.searchsorted(entry, np.arange(len(entries) + 1))  # an entry's terms
        order = np.argsort(self.term_of, kind="stable")
        self.entry, self.weight = entry[order], statistics.weights(terms, tf, sizes[entry])[order]
        self.begin = np.searchsorted(self.term_of[order], np.arange(int(self.term_of.max()) + 2))
        self.n = len(entries)

    def scores(self, seed: int) -> np.ndarray:
        """The score of each entry for the distinct terms of entry `seed`."""
        at = self.term_of[self.first[seed] : self.first[seed + 1]]
        low = self.begin[at]
        many = self.begin[at + 1] - low
        ends = np.cumsum(many)
        post = np.arange(int(ends[-1])) + np.repeat(low - (ends - many), many)
        return np.bincount(self.entry[post], self.weight[post], self.n)


def fill(shard: list[tuple], statistics: Statistics, window: int, opened: list, room: int) -> Iterator[list]:
    """Windows of pieces (entry, from, to) over a shard's entries (row, doc_id, n, ids); opened: the pieces of a window that was left open, with
    `room` free; its seed is a query of this shard's index too. The last list is the window that this shard leaves open."""
    rows = [*shard, *[p[0] for p in opened[:1]]]
    index = Shard([e[3] for e in rows], statistics)
    used = np.zeros(len(rows), bool)
    used[len(shard) :] = True
    next_unused = 0
    pieces, seed = list(opened), len(shard) if opened else None
    while True:
        if seed is None:
            while next_unused < len(shard) and used[next_unused]:
                next_unused += 1
            if next_unused == len(shard):
                break
            seed = next_unused
            used[seed] = True
            pieces.append((rows[seed], 0, len(rows[seed][3])))
            room -= len(rows[seed][3])
        last = seed
        if room:
            left = np.flatnonzero(~used)
            for k in left[np.argsort(-index.scores(seed)[left], kind="stable")].tolist():
                size = min(room, len(rows[k][3]))
                pieces.append((rows[k], 0, size))
                used[k] = True
                room -= size
                last = k
                if not room:
                    break
        if room:
            break  # all entries are used
        yield pieces
        entry, _, to = pieces[-1]
        pieces, room, seed = [], window, None
        if to < len(entry[3]):  # the rest of what was cut
            pieces, room, seed = [(entry, to, len(entry[3]))], window - (len(entry[3]) - to), last
    yield pieces


def powers(pieces: list[tuple]) -> Iterator[list]:
    """An open window cut into sequences of powers of two."""
    size = sum(to - at for _, at, to in pieces)
    waiting = list(pieces)
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            room, out = 1 << bit, []
            while room:
                entry, at, to = waiting.pop(0)
                cut = min(to, at + room)
                out.append((entry, at, cut))
                room -= cut - at
                if cut < to:
                    waiting.insert(0, (entry, cut, to))
            yield out


PIECES = "_row long, doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pieces(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_row", "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _pack(window: int, statistics, shard_tokens: int, shard_entries: int):
    """Entries of a partition, in order, -> pieces; one shard is held at a time. Sequences of a partition have even numbers from its own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, out = statistics.value, 0, []
        shard: list[tuple] = []
        opened: list[tuple] = []
        room, tokens, pid, id_type = window, 0, 0, None

        def told(pieces: list[tuple]) -> None:
            nonlocal count
            offset, sequence = 0, 2 * (pid << 40 | count)
            for (row, doc_id, n, ids), at, to in pieces:
                out.append((row, doc_id, n - len(ids) + at, to - at, ids[at:to].astype("<u4").tobytes(), n, sequence, offset))
                offset += to - at
            count += 1

        def emptied() -> None:
            nonlocal shard, tokens, opened, room
            windows = fill(shard, known, window, opened, room)
            held = next(windows)
            for pieces in windows:
                told(held)
                held = pieces
            opened, room = held, window - sum(to - at for _, at, to in held)
            shard, tokens = [], 0

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("_row", "doc_id", "n", "ids", "_pid")]
            for row, doc_id, n, raw, pid in zip(*columns, strict=True):  # noqa: B007  pid is one for all
                shard.append((row, doc_id, n, _unpacked(raw, n % window)))
                tokens += n % window
                if tokens >= shard_tokens or len(shard) >= shard_entries:
                    emptied()
                    if out:
                        yield _pieces(out, id_type)
                    out = []
        if shard:
            emptied()
        for pieces in powers(opened):
            told(pieces)
        if out:
            yield _pieces(out, id_type)

    return run


def _windows(window: int):
    """The whole windows of documents as sequences of odd numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, id_type = [], batch.schema.field("doc_id").type
            for row, doc_id, raw, n, pid, at in zip(*[batch.column(c).to_pylist() for c in ("_row", "doc_id", "ids", "n", "_pid", "_at")], strict=True):
                ids = _unpacked(raw, n).astype("<u4")
                out += [(row, doc_id, k * window, window, ids[k * window : (k + 1) * window].tobytes(), n, 2 * (pid << 40 | at + k) + 1, 0) for k in range(n // window)]
            if out:
                yield _pieces(out, id_type)

    return run


def pack_lexically(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] = FILES, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens (a power of two): doc_id, start (the document's tokens before it), length, ids (32-bit little-
    endian), doc_tokens, sequence_id, offset (in its sequence).

    Every token of every row is in one piece. Sequences are full but for those that close a partition, which have powers of two
    tokens. Null text: empty; an empty text is its closing id alone. Repeated rows are packed each; ties of scores go by the
    order of entries; an empty table gives an empty result; other columns are ignored. tokenizer: a tokenizer and its vocabulary as ranks, files of
    public_tokenizers or paths that every executor can open; ids are the tokenizer's. A document's ids are held by one task at a time, and a shard of `shard_tokens` tokens or `shard_entries` entries.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("_row"), named(df, id_col).alias("doc_id"), named(df, text_col).alias("text"), F.spark_partition_id().alias("_pid"))
    tokens = stored(rows.mapInArrow(_tokenize(tokenizer, window), TOKENS.format(id=id_type)), "pack-tokens")
    counts = tokens.select("ids", "n").mapInArrow(_frequencies, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).collect()  # as many as the vocabulary
    total = tokens.agg(F.count("*").alias("n"), F.avg(F.when(F.col("n") % window > 0, F.col("n") % window)).alias("mean")).first()
    df_of = np.zeros(max((r["token"] for r in counts), default=0) + 1, np.int64)
    df_of[[r["token"] for r in counts]] = [r["df"] for r in counts]
    statistics = spark.sparkContext.broadcast(Statistics(total["n"], total["mean"] or 1.0, df_of))
    entries = tokens.select("_row", "doc_id", "ids", "n").mapInArrow(_entries(window, statistics), f"_row long, doc_id {id_type}, n long, ids binary, _t1 long, _t2 long")
    order = ["_t1", "_t2", "_row"]
    dealt = entries.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    packed = dealt.mapInArrow(_pack(window, statistics, shard_tokens, shard_entries), PIECES.format(id=id_type))
    long = tokens.filter(F.col("n") >= window).mapInArrow(_windows(window), PIECES.format(id=id_type))
    return packed.unionByName(long).drop("_row")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    pieces = pack_lexically(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
