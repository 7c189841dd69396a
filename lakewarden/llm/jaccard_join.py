"""Exact similarity join on word shingles with a token-group matrix, and its classes.

1. Every text becomes a set of 63-bit shingle fingerprints, stored once; equal sets are one row from here on.
2. Partition: sets that agree in several min-hashes are compared with one pivot each, in several rounds with other pivots for
   those that found none; verified links make the groups of similar documents (every other set is a group of its own).
3. Tokens are in one global order: those of a single group first, then by the number of sets that hold them (rare before
   frequent), then by fingerprint. A prefix is long enough that two sets that link share a token of it. A token of one
   group meets no other, so a set with enough tokens of its own opens nothing, whatever passages it shares.
4. The token-group matrix has a row for each shared token and group whose members' prefixes hold the token. A query that
   meets a group there opens it only if the bound on its overlap with the group's token union (marks of all its members'
   tokens) reaches what the group's sizes ask for. Members of opened groups are compared exactly, and links are merged
   into classes.

For the counts, tokens travel in packed chunks: a task deals a chunk of sets by token into buckets, a bucket counts its
tokens over all sets and sends the shared ones back to their chunk. Pairs inside a class that is already linked are
never opened, so a group of thousands of near copies costs a number of comparisons in proportion to its size; no link
between different classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_small_batches, kept, named, partitions, scratch, stored, table, trimmed
from .components import components
from .decontamination import small

HASHES, AGREE = 6, 3  # min-hashes of a set; how many must agree to compare with a pivot
ROUNDS = 3  # of pivots; more or fewer change no result
PACKED, NEAREST = 256, 3  # members in a block of a group; how many of a block are compared at first
BITS = 2048  # parity bits of a set: as many as differ between two sets, so many tokens at least do; as many marks of its tokens
SEGMENT = 1 << 19  # bytes that are hashed side by side
TASK_TOKENS = 1 << 19  # of a bucket at least, and twice those of a chunk
BUCKETS = 2  # times the shuffle's partitions: buckets and chunks are dealt to so many tasks at least


def dealing(tokens: int, least: int) -> tuple[int, int]:
    """(buckets, tokens of a chunk) for so many tokens in all. A bucket holds TASK_TOKENS or, of a very large corpus, 16 times the root of all tokens: a task's
    memory grows with the root of the corpus, whatever the partitions, and a chunk still leaves a bucket 128 tokens."""
    size = max(TASK_TOKENS, 16 * isqrt(tokens))
    return max(least, -(-tokens // size)), size // 2

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BASE = 0x9FB21C651E98DF25
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)  # of bytes, the same everywhere


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of _BASE and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            of = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))
            self.up, self.down = of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _hashed_words(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 64-bit hashes) of the words of lower-case bytes: a polynomial in a word's bytes, then mixed."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers.reach(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * powers.up[: len(raw)], dtype=np.uint64)))
        words = (sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return starts, _mixed(words)


def words_of(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, one after another; the number of words of each text). A-Z count as a-z."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    hashes, counts, at = [], np.zeros(len(raw), np.int64), 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (size == 0 or size + len(raw[end]) < SEGMENT):
            size, end = size + len(raw[end]) + 1, end + 1
        if end == at + 1 and len(raw[at]) > SEGMENT:  # a very long text, cut between words
            text, a = raw[at], 0
            while a < len(text):
                b = a + SEGMENT
                while b < len(text) and not _SPACE[text[b]]:
                    b += 1
                own = _hashed_words(text[a:b], powers)[1]
                hashes.append(own)
                counts[at] += len(own)
                a = b
        else:
            starts, own = _hashed_words(b" ".join(raw[at:end]), powers)
            offsets = np.cumsum([0] + [len(x) + 1 for x in raw[at:end]])
            counts[at:end] = np.diff(np.searchsorted(starts, offsets))
            hashes.append(own)
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingles_of(texts: Iterable[str | None], size: int, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct fingerprints of each text's shingles of `size` words (A-Z lower-cased, white space
    apart); of all its words as one if there are fewer; none without words. Many texts are hashed at once."""
    words, lengths = words_of(list(texts), powers)
    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)

    def hashed(w: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(w) - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                h = _mixed(h * np.uint64(_BASE) + w[i : len(w) - size + 1 + i])
        return h >> np.uint64(1)  # the same order for signed and unsigned numbers

    every, out = hashed(np.concatenate((words, np.zeros(size, np.uint64))), size), []
    for n, at in zip(lengths.tolist(), starts.tolist(), strict=False):
        s = np.sort(every[at : at + n - size + 1]) if n >= size else hashed(words[at : at + n], n) if n else every[:0]
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def _texts(column: pa.Array, most: int = SEGMENT) -> Iterator[list[str | None]]:
    """The texts of a column in blocks of some `most` characters."""
    block, total = [], 0
    for x in column:
        block.append(x.as_py())
        total += len(block[-1] or "")
        if total >= most:
            yield block
            block, total = [], 0
    if block:
        yield block


def _slots(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(64 - BITS.bit_length())).astype(np.int64), minlength=BITS)


def _sketched(size: int):
    """rid, id, n, set_key (128 bits of the whole set), tokens, min-hashes and parity bits of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            at = 0
            for block in _texts(batch.column(2)):
                sets = shingles_of(block, size, powers)
                n = np.array([len(s) for s in sets])
                flat, some = np.concatenate(sets), np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                mins, bits = np.full(len(sets), None), np.full(len(sets), None)
                if len(some):
                    with np.errstate(over="ignore"):
                        lows = np.stack([np.minimum.reduceat(flat * m, starts) for m in _MULTIPLIERS[:HASHES]], axis=1).view(np.int64)
                    for k, i in enumerate(some.tolist()):
                        mins[i], bits[i] = lows[k], np.packbits((_slots(sets[i]) & 1).astype(np.uint8)).view(np.int64)
                for i in np.flatnonzero(n == 0).tolist():
                    mins[i] = bits[i] = []
                tokens = [s.tobytes() for s in sets]
                made = [pa.array(n, pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in tokens], pa.binary()), pa.array(tokens, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block)), *made], ["rid", "id", "n", "set_key", "tokens", "mins", "bits"])
                at += len(block)

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, marks) of sets (rid, tokens): a bit for each slot that a token falls in."""
    for batch in batches:
        marks = [np.packbits(_slots(np.frombuffer(x.as_buffer(), np.uint64)) > 0).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int64()))], ["rid", "marks"])


def _linked(num: int, den: int):
    """Of pairs (a, b, tokens of each), those whose Jaccard similarity is num/den at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _dealt(buckets: int, chunk: int):
    """Chunks of sets (rid, gid, n, tokens), dealt by token: a row for each chunk and bucket with the tokens in it (what is
    left of them beside the bucket's number, in 32 bits: tokens that fall together only count as more frequent) and the sets that hold them."""

    def flushed(sets: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        rid, gid, n = (np.array([x[i] for x in sets], np.int64) for i in range(3))
        tokens = np.concatenate([x[3] for x in sets])
        bucket, rest = (tokens % np.uint64(buckets)).astype(np.int32), (tokens // np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        owner, rest = np.repeat(np.arange(len(sets)), n)[order], rest[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            own = owner[ends[b] : ends[b + 1]]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            who, runs = own[first], np.diff(np.append(first, len(own)))
            steps = np.diff(rid[who], prepend=0)  # and the differences of gid: small numbers, which shuffles pack well
            rows.append((b, sets[0][0], rest[ends[b] : ends[b + 1]].tobytes(), steps.tobytes(), (gid[who] - rid[who]).tobytes(), n[who].astype(np.int32).tobytes(), runs.astype(np.int32).tobytes()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "chunk", "tokens", "rids", "gids", "ns", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total = [], 0
        for batch in batches:
            for rid, gid, n, tokens in zip(*batch.columns, strict=True):
                sets.append((rid.as_py(), gid.as_py(), n.as_py(), np.frombuffer(tokens.as_py(), np.uint64)))
                total += sets[-1][2]
                if total >= chunk:
                    yield flushed(sets)
                    sets, total = [], 0
        if sets:
            yield flushed(sets)

    return run


def _shared(buckets: int):
    """Of each bucket's tokens those that sets of several groups hold: (bucket, chunk, tokens, levels, rids, gids, ns, runs) for each chunk."""

    def counted(bucket: int, rows: list) -> pa.RecordBatch:
        of = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        tokens, runs, steps, n = of("tokens", np.uint32), of("runs", np.int32), of("rids", np.int64), of("ns", np.int32)
        rids = [np.cumsum(x) for x in steps]
        gids = [x + y for x, y in zip(rids, of("gids", np.int64), strict=True)]
        every, gid = np.concatenate(tokens), np.concatenate([np.repeat(x, k) for x, k in zip(gids, runs, strict=True)])
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        counts = np.diff(np.append(first, len(every)))
        several = np.minimum.reduceat(gid[order], first) != np.maximum.reduceat(gid[order], first)
        level = np.zeros(len(every), np.uint8)
        level[order] = np.repeat(np.where(several, np.log2(counts).astype(np.uint8), 0), counts)  # two sets at least: level 1
        out, at = [], 0
        for k, row in enumerate(rows):
            own = level[at : at + len(tokens[k])]
            at += len(own)
            hits = np.flatnonzero(own)
            if len(hits):
                hold = np.bincount(np.repeat(np.arange(len(runs[k])), runs[k])[hits], minlength=len(runs[k]))
                some = np.flatnonzero(hold)
                out.append((bucket, row["chunk"], tokens[k][hits].tobytes(), own[hits].tobytes(), np.diff(rids[k][some], prepend=0).tobytes(), (gids[k] - rids[k])[some].tobytes(), n[k][some].tobytes(), hold[some].astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], ["bucket", "chunk", "tokens", "levels", "rids", "gids", "ns", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                found.setdefault(row["bucket"], []).append(row)
        for bucket in list(found):
            yield counted(bucket, found.pop(bucket))

    return run


def _prefixed(num: int, den: int, buckets: int):
    """The tokens of each set's prefix that other groups hold too: rid, n, gid, token and pos, its place in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        of = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        runs, rids = of("runs", np.int32), [np.cumsum(x) for x in of("rids", np.int64)]
        spread = lambda parts: np.concatenate([np.repeat(x, k) for x, k in zip(parts, runs, strict=True)])
        token = np.concatenate([x.astype(np.int64) * buckets + r["bucket"] for x, r in zip(of("tokens", np.uint32), rows, strict=True)])
        level, rid, n = np.concatenate(of("levels", np.uint8)), spread(rids), spread(of("ns", np.int32)).astype(np.int64)
        gid = spread([x + y for x, y in zip(rids, of("gids", np.int64), strict=True)])
        order = np.lexsort((token, level, rid))
        first = np.flatnonzero(np.concatenate(([True], rid[order][1:] != rid[order][:-1])))
        counts = np.diff(np.append(first, len(order)))
        pos = n[order] - np.repeat(counts, counts) + np.arange(len(order)) - np.repeat(first, counts)  # tokens of its own come first
        inside = pos < n[order] - -(-num * n[order] // den) + 1
        at = order[inside]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid[at], n[at], gid[at], token[at], pos[inside])], ["rid", "n", "gid", "token", "pos"])

    return run


def _near(num: int, den: int, most: int | None):
    """Rows (rid, n, group, bits, members: rid, n, bits) to pairs (a, b) that may link, by sizes and parity bits: the `most`
    nearest of each row; cut: whether there were more. Larger members are left to their own queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, group, cut = [], [], [], []
            rids, sizes, groups = (batch.column(i).to_pylist() for i in range(3))
            bits = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rids), -1)
            members = batch.column(4)
            flat, ends = members.flatten(), members.offsets.to_numpy()
            ends = ends - ends[0]
            other = flat.field(0).to_numpy(zero_copy_only=False)
            n = flat.field(1).to_numpy(zero_copy_only=False)
            theirs = flat.field(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(other), -1)
            owner = np.repeat(np.arange(len(rids)), np.diff(ends))
            mine = np.asarray(sizes)[owner]
            differ = np.bitwise_count(bits[owner] ^ theirs).sum(axis=1).astype(np.int64)
            fine = (n <= mine) & (mine * num <= n * den) & (differ * (den + num) <= (mine + n) * (den - num))
            for row in np.unique(owner[fine]):
                at = np.arange(ends[row], ends[row + 1])[fine[ends[row] : ends[row + 1]]]
                if most and len(at) > most:
                    at = at[np.argsort(differ[at], kind="stable")][:most]
                    cut += [True] * len(at)
                else:
                    cut += [False] * len(at)
                a += [rids[row]] * len(at)
                group += [groups[row]] * len(at)
                b += other[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(group, pa.int64()), pa.array(cut, pa.bool_())], ["a", "b", "group", "cut"])

    return run


def _close(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by their parity bits: two sets differ in as many tokens as their bits do, or more,
    and J >= num/den means a symmetric difference of (den - num) / (den + num) * (na + nb) at most."""
    side = lambda k: sketches.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b")
    return stored(close, "close-pairs")


def _linked_pairs(close: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link, token by token; sets are sent once for each pair."""
    rows = close.count()
    of = lambda k: sketches.select(F.col("rid").alias(k), F.col("tokens").alias(f"t{k}"))
    left = of("a").join(small(close, rows), "a")
    right = of("b").join(small(close.select("b").distinct(), rows), "b", "left_semi")
    return stored(left.join(right, "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(_linked(num, den)), "a long, b long").distinct(), "links")


def _pivot_links(reps: DataFrame, sketches: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Verified links of sets with the pivots of their min-hashes. Sets that found none go on to the next round with the
    pivots and meet others."""
    found, nodes = [], reps.select("rid", "n", "mins")
    near = (F.col("n") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("n") * den)
    for turn in range(ROUNDS):
        buckets = nodes.select("rid", "n", F.posexplode("mins").alias("h", "v"))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "rid").alias("o"), "rid", "n"))
        pivots = buckets.groupBy("h", "v").agg(F.count("*").alias("c"), first.alias("p")).filter("c > 1").select("h", "v", F.col("p.rid").alias("b"), F.col("p.n").alias("nb"))
        stars = buckets.join(pivots, ["h", "v"]).filter((F.col("rid") != F.col("b")) & near).groupBy(F.col("rid").alias("a"), "b").agg(F.count("*").alias("c")).filter(F.col("c") >= AGREE).select("a", "b")
        close = _close(stars, sketches, num, den)
        links = _linked_pairs(close, sketches, num, den)
        discard(close)
        n_links = links.count()
        if not n_links:
            break
        found.append(links)
        nodes = nodes.join(small(links.select(F.col("a").alias("rid")).distinct(), n_links), "rid", "left_anti")
    return found


def _prefixes(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """rid, n, gid, token, pos of the tokens in the prefixes of sets that other groups hold too."""
    tokens = grouped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, chunk = dealing(tokens, BUCKETS * partitions(grouped.sparkSession))
    dealt = grouped.select("rid", "gid", "n", "tokens").mapInArrow(trimmed(_dealt(n, chunk)), "bucket int, chunk long, tokens binary, rids binary, gids binary, ns binary, runs binary")
    back = dealt.repartition(n, "bucket").mapInArrow(trimmed(_shared(n)), "bucket int, chunk long, tokens binary, levels binary, rids binary, gids binary, ns binary, runs binary")
    return stored(back.repartition(n, "chunk").mapInArrow(trimmed(_prefixed(num, den, n)), "rid long, n long, gid long, token long, pos long"), "prefixes")


def _qualifying(met: DataFrame, grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (rid, group) that met in the matrix, those whose overlap with the group's token union may be enough: a mark
    of the query that no member has stands for a token that is not in the union."""
    rows = met.count()
    marked = lambda needed: grouped.join(small(needed, rows), needed.columns, "left_semi")
    sizes, words = grouped.select("rid", "n"), BITS // 64
    queries = met.join(sizes, "rid").join(marked(met.select("rid").distinct()).select("rid", "tokens").mapInArrow(trimmed(_marks), "rid long, marks array<long>"), "rid")
    members = marked(met.select(F.col("group").alias("gid")).distinct())
    marks = members.select("rid", "tokens").mapInArrow(trimmed(_marks), "rid long, marks array<long>")
    members = members.select("rid", F.col("gid").alias("group"), F.col("n").alias("m")).join(marks, "rid")
    unions = members.groupBy("group").agg(F.min("m").alias("least"), *[F.bit_or(F.col("marks")[i]).alias(f"u{i}") for i in range(words)])
    unions = unions.select("group", "least", F.array(*[f"u{i}" for i in range(words)]).alias("union"))
    missing = F.aggregate(F.zip_with("marks", "union", lambda q, u: F.bit_count(q.bitwiseAND(F.bitwise_not(u)))), F.lit(0), lambda s, x: s + x)
    least = F.greatest("least", F.ceil(F.col("n") * num / den))
    return queries.join(unions, "group").filter(F.col("n") - missing >= F.ceil(F.lit(num) * (F.col("n") + least) / F.lit(num + den))).select("rid", "group")


@in_small_batches
def similar_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Classes of the texts of df that link: shingles of `size` words, Jaccard similarity num/den at least.

    Returns rid (a number of the input row), id, n_shingles and component, the smallest rid reachable by links,
    itself included. Null and wordless texts have empty sets and link with nothing, not even each other. Repeated
    rows and equal sets link. Null ids are allowed; an empty table gives an empty result. Very long texts are hashed in
    pieces between words; a set is one row.
    """
    docs = df.select(F.monotonically_increasing_id().alias("_rid"), named(df, id_col).alias("_id"), named(df, text_col).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    all_sets = stored(docs.mapInArrow(trimmed(_sketched(size)), f"rid long, id {id_type}, n long, set_key binary, tokens binary, mins array<long>, bits array<long>"), "sketches")
    sketch = all_sets.select("rid", "n", "tokens", "bits")

    # one row for each different set: all but the repetitions
    firsts = stored(all_sets.filter("n > 0").groupBy("set_key").agg(F.min("rid").alias("rid"), F.count("*").alias("c")), "firsts")
    repeated = firsts.filter("c > 1").select("set_key", F.col("rid").alias("first"))
    again = stored(all_sets.select("rid", "set_key").join(small(repeated, repeated.count()), "set_key").filter("rid <> first").select("rid"), "repetitions")
    reps = all_sets.filter("n > 0").join(small(again, again.count()), "rid", "left_anti")

    # groups: sets and the pivots with which several min-hashes agree
    links = df.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))  # rows of the driver's Python would start workers of their own
    for found in _pivot_links(reps, sketch, num, den):
        links = links.unionByName(found)
    groups = stored(components(links), "groups")
    n_groups = groups.count()
    place = lambda key, name: groups.select(F.col("node").alias(key), F.col("component").alias(name))

    def merged(links: DataFrame) -> DataFrame:
        """(gid, component): the groups that links between their members join."""
        ends = links.join(small(place("a", "ga"), n_groups), "a", "left").join(small(place("b", "gb"), n_groups), "b", "left")
        return components(ends.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))).select(F.col("node").alias("gid"), "component")

    grouped = reps.join(small(groups, n_groups), F.col("rid") == F.col("node"), "left").select("rid", "n", F.coalesce("component", "rid").alias("gid"), "tokens", "bits")

    # the matrix, and the queries' prefixes against it
    prefixes = _prefixes(grouped, num, den)
    index = F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den)) + 1
    matrix = prefixes.filter(F.col("pos") < index).groupBy("token", F.col("gid").alias("group")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first"))
    # overlaps asked for with the smallest and the largest member that fit, and what is left behind the token on either side
    need = lambda other: F.ceil(F.lit(num) * (F.col("n") + other) / F.lit(num + den))
    low, high = F.greatest("least", F.ceil(F.col("n") * num / den)), F.least("most", "n")
    sizes = (F.col("least") <= F.col("n")) & (F.col("most") * den >= F.col("n") * num)
    bound = (F.col("n") - F.col("pos") >= need(low)) & (high - F.col("first") >= need(high))
    met = stored(prefixes.join(matrix, "token").filter((F.col("gid") != F.col("group")) & sizes & bound).select("rid", "group").distinct(), "met")
    opened = stored(_qualifying(met, grouped, num, den), "opened")
    n_opened = opened.count()

    # opened groups, packed: all of a block's members meet a query at once
    members = grouped.join(small(opened.select(F.col("group").alias("gid")).distinct(), n_opened), "gid", "left_semi").select(F.col("gid").alias("group"), "rid", "n", "bits")
    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / PACKED).alias("blocks"))
    packed = stored(members.join(blocks, "group").groupBy("group", F.pmod(F.xxhash64("rid"), "blocks").alias("block")).agg(F.collect_list(F.struct("rid", "n", "bits")).alias("members")), "packed")
    queries, links = opened, None
    for most in (NEAREST, None):
        asked = grouped.select("rid", "n", "bits").join(small(queries, n_opened), "rid")
        near = stored(asked.join(packed, "group").select("rid", "n", "group", "bits", "members").mapInArrow(trimmed(_near(num, den, most)), "a long, b long, group long, cut boolean"), "near")
        found = _linked_pairs(near.select("a", "b"), sketch, num, den)
        links = found if links is None else links.unionByName(found)
        # a query that was cut off goes on where it is not yet in the group's class
        again = near.filter("cut").select("a", "group").distinct()
        if most is None or again.isEmpty():
            break
        classes = stored(merged(links), "classes-so-far")
        of = lambda key, name: classes.select(F.col("gid").alias(key), F.col("component").alias(name))  # noqa: B023, E731
        again = again.join(place("a", "ga"), "a", "left").withColumn("ga", F.coalesce("ga", "a")).join(of("ga", "ca"), "ga", "left").join(of("group", "cg"), "group", "left")
        queries = stored(again.filter(F.coalesce("ca", "ga") != F.coalesce("cg", "group")).select(F.col("a").alias("rid"), "group"), "opened-again")

    classes = stored(merged(links), "classes")
    firsts = firsts.join(small(place("rid", "gid"), n_groups), "rid", "left").withColumn("gid", F.coalesce("gid", "rid")).join(small(classes, classes.count()), "gid", "left")
    firsts = firsts.select("set_key", F.coalesce("component", "gid").alias("component"))
    out = all_sets.select("rid", "id", "n", "set_key").join(firsts, "set_key", "left")
    return out.select("rid", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("rid")).alias("component"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents: 4-word shingles, Jaccard similarity 0.85; component_id is the smallest doc_id."""
    with scratch():
        found = kept(stored(similar_classes(table(spark, sf_dir, "documents"), size=4, num=85, den=100), "classes"))
    names = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(names, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
