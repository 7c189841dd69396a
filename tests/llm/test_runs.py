"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lakewarden.llm import periodic_runs as runs

SCHEMA = "doc_id long, text string, runs string, n_words string, collapsed int"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), digest(kept))


def texts(seed, n):
    """Random words of small alphabets, repeated stretches, nested repeats, Fibonacci words, repeated lines."""
    pick = random.Random(seed)
    fib = ["a", "a b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + " " + fib[-2])
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 13, "a b " * 6, "a b " * 6 + "a", fib[-1], "x y z " * 300, "u\x0bv\x0cw\r" * 5, "é b " * 12, "line of words\n" * 40]
    for _ in range(n):
        alphabet = "abcdefghijklmnop"[: pick.choice([1, 2, 3, 16])]
        words = [pick.choice(alphabet) for _ in range(pick.randrange(80))]
        for _ in range(pick.randrange(4)):
            i = pick.randrange(len(words) + 1)
            piece = words[i : i + pick.randrange(1, 14)]
            words[i:i] = piece * pick.randrange(1, 9)
        out.append(" ".join(words))
    return out


def test_runs_equal_the_plain_search():
    cases = [(t or "").encode().split() for t in texts(3, 500)]
    assert runs.block_runs(cases) == [brute_runs(w) for w in cases]
    for w in cases[:40]:
        assert runs.block_runs([w]) == [brute_runs(w)]
    assert runs.block_runs([]) == []


def test_grammar_derives_the_text():
    """Each nonterminal stands for the same words at all of its places, its sides are words or nonterminals, and pairs repeat."""
    words = "the cat sat on the mat the cat sat on the rug the cat ran".split()
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    begin, middle, end, what, where = runs.re_pair(ids, np.array([0]))
    spans = {(int(p), int(p + end[k] - begin[k])) for k, p in zip(what, where, strict=True)}
    for k, p in zip(what, where, strict=True):
        n = end[k] - begin[k]
        assert list(ids[p : p + n]) == list(ids[begin[k] : end[k]])
        half = middle[k] - begin[k]
        for s, e in ((p, p + half), (p + half, p + n)):
            assert e == s + 1 or (int(s), int(e)) in spans
    assert (0, len(words)) in spans and len(spans) == len(words) - 1  # a binary derivation
    assert np.bincount(what).max() >= 3  # "the cat" is one nonterminal


def test_blocks_do_not_mix_documents(monkeypatch):
    """Copies side by side, and a block size that puts each document in a block of its own, give the same."""
    w = "p q r s t u v".split() * 2
    cases = [[x.encode() for x in w]] * 3
    assert runs.block_runs(cases) == [[(0, 14, 7)]] * 3


def test_query_equals_the_plain_search(spark, tmp_path):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts(8, 120))] + [(3, "a b c d e f g " * 9, "x", "y", 1)] * 2
    rows += [(i, " ".join(f"w{k}" for k in range(60 + i)), "x", "y", 1) for i in range(1000, 1060)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(r[0], r[1]) for r in rows), key=str)


def test_long_and_empty(spark, monkeypatch):
    assert runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    pick = random.Random(2)
    prose = [pick.choice(["so", "it", "goes"]) + str(pick.randrange(50)) for _ in range(30_000)]
    long = " ".join(prose[:20_000] + prose[100:9_000] * 3 + ["end"])
    row = spark.createDataFrame([(1, long, "x", "y", 1)], SCHEMA).select("doc_id", "text").transform(runs.find_runs).select(F.explode("runs").alias("r")).select("r.*").collect()
    assert (20_000, 3 * 8_900, 8_900) in [tuple(r) for r in row] or any(r["period"] == 8_900 and r["length"] >= 3 * 8_900 for r in row)
    words = ["same"] * 100_000
    assert runs.block_runs([[b"same"] * len(words)]) == [[(0, 100_000, 1)]]
