"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period q, at least max(12, 2q) long, that can't be extended with that period. Within a
task documents come in blocks of some 200,000 words, whole documents each, and numpy works on a block at once:

1. Re-Pair: pairs of neighbouring symbols that repeat in a document become nonterminals, the commonest first, round after
   round, until no pair repeats. What is left of a document is paired in balanced order up to one root. Words have numbers of
   their own in each document, so nothing meets across documents.
2. Each nonterminal is looked at once, at its first place: the runs that cross the boundary between its two sides. A run of
   period q repeats six words at distance q beside every boundary it crosses (12 - q or q of its words at least have an equal
   one q further on, six or more in either case), so the places of six equal words within the nonterminal give the periods to try;
   how far a period holds is read from the names of equal stretches of 2^k words.
3. What is found is translated to all places of the nonterminal in the derivation, and overlapping stretches of one period are
   merged; of equal stretches the smallest period stays. Every run has one nonterminal that is the lowest to hold it whole, so
   its full extent is among the stretches merged.

Documents in which no six words occur twice have no run and need no grammar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, named, table

LEAST = 12  # words of a run
ANCHOR = 6  # words that any run repeats beside a boundary
BLOCK = 200_000  # words that are worked on at once, or one longer document


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each different key that occurs more than once, -1 for the others; how many numbers."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group) > 1
    number = np.where(several, np.cumsum(several) - 1, -1)
    out = np.empty(len(keys), np.int64)
    out[order] = number[group]
    return out, int(several.sum())


def _joined(a: np.ndarray, b: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Names of a stretch named in a followed by one named in b, `shift` later; -1 where it does not repeat."""
    out = np.full(len(a), -1, np.int64)
    at = np.flatnonzero(a[: len(a) - shift] >= 0) if shift < len(a) else np.empty(0, np.int64)
    at = at[b[at + shift] >= 0]
    if len(at):
        out[at] = _names(a[at] * n + b[at + shift])[0]
    return out


def re_pair(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The grammar of documents laid end to end: ids of words (different in different documents) and where documents begin.

    Returns for each nonterminal its first place: begin, boundary, end; and for each place of the derivation its nonterminal and
    begin."""
    symbol, place = ids.copy(), np.arange(len(ids))
    document = np.zeros(len(ids), np.int64)
    document[starts[1:]] = 1
    document = np.cumsum(document)
    ends = np.append(place[1:], len(ids))
    begin, middle, end, what, where = [], [], [], [], []
    rules, next_symbol = 0, int(ids.max()) + 1 if len(ids) else 0

    def replace(at: np.ndarray, name: np.ndarray, first: np.ndarray) -> None:
        """Symbols at `at` and after it become one of the new ones; name numbers them, first is where each is first."""
        nonlocal symbol, place, ends, document, rules, next_symbol
        n = len(first)
        begin.append(place[first])
        middle.append(place[first + 1])
        end.append(ends[first + 1])
        what.append(rules + name)
        where.append(place[at])
        symbol[at] = next_symbol + name
        ends[at] = ends[at + 1]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, place, ends, document = symbol[stays], place[stays], ends[stays], document[stays]
        rules, next_symbol = rules + n, next_symbol + n

    rest = []
    while len(symbol) > 1:
        pair, n = _names(symbol[:-1] * next_symbol + symbol[1:])
        pair[document[:-1] != document[1:]] = -1
        # of a pair that follows itself (a a a) every other place counts
        again = np.zeros(len(pair), bool)
        again[1:] = (pair[1:] == pair[:-1]) & (pair[1:] >= 0)
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(pair))))
        pair[(np.arange(len(pair)) - head) % 2 == 1] = -1
        count = np.bincount(pair[pair >= 0], minlength=n)
        rank = np.empty(n + 1, np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(n) if n else rank[:0]
        rank[n] = -1
        power = np.where((pair >= 0) & (count[pair] > 1) if n else pair >= 0, rank[pair], -1)
        # a place is taken where no neighbouring pair is commoner
        beats = power >= 0
        beats[1:] &= power[1:] > power[:-1]
        beats[:-1] &= power[:-1] > power[1:]
        at = np.flatnonzero(beats)
        if len(at):
            taken = np.bincount(pair[at], minlength=n) > 1
            at = at[taken[pair[at]]]
        if not len(at):
            break
        live = np.zeros(int(document[-1]) + 1, bool)
        live[document[at]] = True
        _, first, name = np.unique(pair[at], return_index=True, return_inverse=True)
        replace(at, name, at[first])
        done = ~live[document]
        if done.any():  # documents without a pair that repeats have their rules
            rest.append((symbol[done], place[done], ends[done], document[done]))
            symbol, place, ends, document = symbol[~done], place[~done], ends[~done], document[~done]
    rest.append((symbol, place, ends, document))
    symbol, place, ends, document = (np.concatenate(x) for x in zip(*rest, strict=True))
    order = np.argsort(place, kind="stable")
    symbol, place, ends, document = symbol[order], place[order], ends[order], document[order]
    while len(symbol) > 1:  # balanced pairs up to the roots
        first = np.ones(len(symbol), bool)
        first[1:] = document[1:] != document[:-1]
        index = np.arange(len(symbol)) - np.maximum.accumulate(np.where(first, np.arange(len(symbol)), 0))
        at = np.flatnonzero((index[:-1] % 2 == 0) & ~first[1:])
        if not len(at):
            break
        replace(at, np.arange(len(at)), at)
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (begin, middle, end, what, where))


def _levels(ids: np.ndarray) -> list[np.ndarray]:
    """Names of the repeated stretches of 1, 2, 4, ... words that begin at each place."""
    first, n = _names(ids)
    out = [first.astype(np.int32)]
    while n:
        wide = _joined(out[-1].astype(np.int64), out[-1].astype(np.int64), 1 << (len(out) - 1), n)
        n = int(wide.max()) + 1 if len(wide) else 0
        if n:
            out.append(wide.astype(np.int32))
    return out


def _same_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """How many words from i on equal those from j on."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + length, j + length
        inside = (a < size) & (b < size)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        length += np.where(inside & (levels[k][a] >= 0) & (levels[k][a] == levels[k][b]), 1 << k, 0)
    return length


def _same_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - length - (1 << k), j - length - (1 << k)
        inside = (a >= 0) & (b >= 0)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        length += np.where(inside & (levels[k][a] >= 0) & (levels[k][a] == levels[k][b]), 1 << k, 0)
    return length


def _crossing(ids: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nonterminal, start, end, period) of the periodic stretches that cross a nonterminal's boundary, at its first place."""
    levels = _levels(ids)
    none = (np.empty(0, np.int64),) * 4
    if len(levels) < 3:
        return none
    two = levels[1].astype(np.int64)
    six = _joined(levels[2].astype(np.int64), two, 4, int(two.max()) + 1)
    size = len(ids)
    places = np.flatnonzero(six >= 0)
    places = places[np.argsort(six[places], kind="stable")]  # by name, then by place
    keys = six[places] * size + places
    wide = np.flatnonzero(end - begin >= LEAST)
    found = [none]
    for back in range(ANCHOR + 1):
        anchor = middle[wide] - back
        of = wide[(anchor >= begin[wide]) & (anchor + ANCHOR <= end[wide])]
        anchor = middle[of] - back
        of, anchor = of[six[anchor] >= 0], anchor[six[anchor] >= 0]
        low = np.searchsorted(keys, six[anchor] * size + begin[of])
        high = np.searchsorted(keys, six[anchor] * size + end[of] - ANCHOR, side="right")
        of, anchor, low, many = of[high > low + 1], anchor[high > low + 1], low[high > low + 1], (high - low)[high > low + 1]
        for part in np.array_split(np.arange(len(of)), max(1, int(many.sum()) // 2_000_000 + 1)):  # so many trials at once
            step = np.repeat(np.arange(len(part)), many[part])
            other = places[low[part][step] + np.arange(len(step)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])]
            node, here = of[part][step], anchor[part][step]
            period = np.abs(other - here)
            fits = (period > 0) & (2 * period <= end[node] - begin[node])
            node, period, left = node[fits], period[fits], np.minimum(here, other)[fits]
            if not len(node):
                continue
            start = np.maximum(left - _same_before(levels, left, left + period), begin[node])
            stop = np.minimum(left + period + _same_after(levels, left, left + period, size), end[node])
            good = (stop - start >= np.maximum(LEAST, 2 * period)) & (start < middle[node]) & (stop > middle[node])
            rows = np.unique(np.stack([node[good], start[good], stop[good], period[good]]), axis=1)
            found.append(tuple(rows))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of documents laid end to end, by start, then period."""
    begin, middle, end, what, where = re_pair(ids, starts)
    node, start, stop, period = _crossing(ids, begin, middle, end)
    # to all places of the nonterminals
    order = np.argsort(what, kind="stable")
    low, high = np.searchsorted(what[order], node), np.searchsorted(what[order], node, side="right")
    step = np.repeat(np.arange(len(node)), high - low)
    at = where[order][low[step] + np.arange(len(step)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)] - begin[node[step]]
    start, stop, period = start[step] + at, stop[step] + at, period[step]
    # stretches of one period that share a period's length are one
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    if not len(start):
        return start, stop, period
    reach = np.maximum.accumulate(period * (len(ids) + 1) + stop) - period * (len(ids) + 1)
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    heads = np.flatnonzero(new)
    start, stop, period = start[heads], np.maximum.reduceat(stop, heads), period[heads]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[smallest], stop[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _repeats(ids: np.ndarray) -> np.ndarray:
    """Whether six words from each place on occur twice in its document."""
    levels = [_names(ids)[0]]
    for shift in (1, 2):
        levels.append(_joined(levels[-1], levels[-1], shift, int(levels[-1].max()) + 1 if len(ids) else 1))
    return _joined(levels[2], levels[1], 4, int(levels[1].max()) + 1 if len(ids) else 1) >= 0


def block_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each document, given as its words: the runs (start, length, period)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers: list[np.ndarray] = []
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
    starts = np.cumsum([0, *map(len, numbers)])
    ids = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    hit = np.unique(np.searchsorted(starts, np.flatnonzero(_repeats(ids)), side="right") - 1)
    if not len(hit):
        return out
    kept = [numbers[k] for k in hit]
    offset = np.cumsum([0, *map(len, kept)])
    for s, e, q in zip(*(x.tolist() for x in runs_of(np.concatenate(kept), offset[:-1])), strict=True):
        k = int(np.searchsorted(offset, s, side="right")) - 1
        out[hit[k]].append((s - int(offset[k]), e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def block(rows: list[int], batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = block_runs(texts)
        told = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(run))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(rows)) for c in range(batch.num_columns - 1)], pa.array([len(t) for t in texts], pa.int64()), told, pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())],
            names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
        )

    for batch in batches:
        rows, texts, size = [], [], 0
        column = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            words = (column[i].as_py() or "").encode().split()
            if rows and size + len(words) > BLOCK:
                yield block(rows, batch, texts)
                rows, texts, size = [], [], 0
            rows.append(i)
            texts.append(words)
            size += len(words)
        if rows:
            yield block(rows, batch, texts)


def find_runs(df: DataFrame, text: Column | str = "text", *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (start word, length, period; by start, then period) and collapsed (the text's words, joined by one
    space, without what a run repeats) for each row of df.

    Words are separated by ASCII white space and compared as they are. Null and blank texts have no words, no runs and an
    empty collapsed text; repeated rows give repeated results; runs may overlap; other columns are ignored. A text is worked on
    as a whole by one task, however long: some 200 bytes a word. Nothing is shuffled.
    """
    column = named(df, text) if isinstance(text, str) else text
    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(named(df, id_col).alias("doc_id"), column.alias("text")).mapInArrow(_find, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed string")


def periodic(doc_id: Column, text: Column) -> Column:
    """The contract's texts: with h = crc32(decimal doc_id) and g = h div 10, where h ends in 0, the n words from a = g % n on repeat
    the p = 1 + (n - a) div (3 + g % 8) from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10).cast("long"), F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, F.when(i < a, i + 1).otherwise(a + (i - a) % p + 1).cast("int"))), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]  # words once
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every tenth of them made periodic as the contract says."""
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs, periodic(F.col("doc_id"), F.col("text")))
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
