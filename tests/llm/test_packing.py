"""Packing: an exact round trip of all ids, the law of lengths, BM25 against its formula, neighbours of seeds."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lakewarden.llm import lexical_packing as packing

SCHEMA = "doc_id long, text string, ids string, start int, sequence_id double"
NAME = "byte_bpe_50k.json"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(NAME))


def odd_texts(n):
    pick = random.Random(4)
    parts = ["a", "word", " ", "  ", "\n", " \n", "\t", "É", "don't", "'s", "12", "3,5", "…", "\xa0", " ", "日本", "<|endoftext|>", "x\ny", "\r\n", "\x1c", "\x85", "​", ".", "é", "🙂"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(12))) for _ in range(n)] + [" ".join(pick.choice(parts).strip() or "x" for _ in range(9)) for _ in range(n)] + ["", " ", "  ", "a ", " a"]


def test_ids_equal_those_of_whole_texts():
    texts = odd_texts(3000) + ["a plain line of words and of words"] * 2
    whole = tokenizer().encode_batch(texts, add_special_tokens=False)
    words = packing.vocabulary(packing.FILES)
    assert [words.encode(t).tolist() for t in texts] == [[*e.ids, 0] for e in whole]


def laws(pieces, rows, window):
    """Every id in one piece, gapless offsets, lengths of sequences full or powers of two. Tokens of padding."""
    made = tokenizer()
    want = Counter()
    for doc_id, text in rows:
        want[(doc_id, tuple([*made.encode(text or "", add_special_tokens=False).ids, 0]))] += 1
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"]].append((p["start"], tuple(ids.tolist()), p["doc_tokens"]))
    for own in sequences.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
    for doc_id, n in Counter(d for d, _ in want.elements()).items():
        own = sorted(documents.pop(doc_id))
        texts = [ids for (d, ids), k in want.items() for _ in range(k) if d == doc_id]
        assert sum(len(ids) for _, ids, _ in own) == sum(map(len, texts)) and {t for _, _, t in own} == {len(t) for t in texts}
        if n == 1:
            assert tuple(i for _, ids, _ in own for i in ids) == texts[0] and [s for s, _, _ in own] == list(np.cumsum([0, *[len(i) for _, i, _ in own]])[:-1])
    assert not documents
    sizes = [sum(n for _, n in own) for own in sequences.values()]
    assert max(sizes, default=0) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes)


def corpus(n):
    pick = random.Random(6)
    topics = [[f"{t}{k}" for k in range(40)] for t in ("river", "stone", "cloud", "iron")]
    rows = [(i, " ".join(pick.choice(topics[i % 4]) for _ in range(pick.choice([3, 40, 90, 300])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "same text"), (n + 2, "same text"), (n + 3, "long " * 5000), *[(n + 10 + i, "copy of one text") for i in range(60)]]


def test_round_trip_and_lengths(spark):
    rows = corpus(150)
    df = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SCHEMA)
    assert laws(packing.pack_lexically(df).collect(), rows, 1024) == 0
    assert laws(packing.pack_lexically(df, window=256, shard_tokens=2000, shard_entries=9).collect(), rows, 256) == 0


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus(40)
    spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op13_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    texts, made = dict(rows), tokenizer()
    for r in got.filter(F.col("doc_id") < 40).collect():
        ids = [*made.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack_lexically(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_equal_the_formula():
    entries = [np.array(e) for e in ([5, 5, 7], [7, 8, 9, 9, 9], [5], [1, 2, 3])]
    df = np.array([0, 1, 1, 1, 0, 2, 0, 2, 1, 1])
    shard = packing.Shard(entries, packing.Statistics(4, 3.0, df))

    def score(e, seed):
        out = 0.0
        for t in set(seed.tolist()):
            tf = e.tolist().count(t)
            idf = math.log(1 + (4 - df[t] + 0.5) / (df[t] + 0.5))
            out += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(e) / 3.0))
        return out

    for k, seed in enumerate(entries):
        assert np.allclose(shard.scores(k), [score(e, seed) for e in entries])


def test_windows_hold_neighbours():
    """A seed's window is filled in the order of scores; entries that share no word with it come last."""
    entries = [(0, 0, 4, np.array([1, 2, 3, 0])), (1, 1, 4, np.array([7, 8, 9, 0])), (2, 2, 4, np.array([1, 2, 4, 0])), (3, 3, 4, np.array([7, 8, 5, 0])), (4, 4, 4, np.array([1, 6, 6, 0]))]
    df = np.bincount(np.concatenate([np.unique(e[3]) for e in entries]), minlength=10)
    windows = list(packing.fill(entries, packing.Statistics(5, 4.0, df), 8, [], 8))
    assert [[p[0][0] for p in w] for w in windows] == [[0, 2], [1, 3], [4]]
    cut = list(packing.fill(entries, packing.Statistics(5, 4.0, df), 6, [], 6))
    assert [(p[0][0], p[1], p[2]) for p in cut[0]] == [(0, 0, 4), (2, 0, 2)] and cut[1][0] == (entries[2], 2, 4)
    assert [sum(b - a for _, a, b in w) for w in packing.powers([(entries[0], 0, 4), (entries[1], 0, 3)])] == [4, 2, 1]


def test_related_texts_share_sequences(spark):
    rows = [(i, " ".join(random.Random(i).choice([f"{'abcd'[i % 4]}topic{k}" for k in range(30)]) for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SCHEMA)
    by = defaultdict(set)
    for r in packing.pack_lexically(df).collect():
        by[r["sequence_id"]].add(r["doc_id"] % 4)
    full = [len(s) for s in by.values()]
    assert sum(full) / len(full) < 2.5  # of four topics; chance would give four
