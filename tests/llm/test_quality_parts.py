"""Token properties by their short ways, and a training sample that lies in many partitions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from lakewarden.llm import quality as Q


def test_short_ways_of_tokens_equal_the_patterns():
    draw = random.Random(3)
    tokens = ["", *["".join(draw.choice("abzABZ09.,!?_-éÉßǅ中ªⅷ²'") for _ in range(draw.randint(1, 6))) for _ in range(20_000)]]
    for t in tokens[1:]:
        word = re.sub(r"^[\W_]+|[\W_]+$", "", t).lower()
        shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_a-zA-Z]+", "a", t))))
        assert Q.token_slots(t) == tuple(zlib.crc32(x.encode()) % Q.SLOTS for x in ("w:" + word, "b:" + word[:5], "s:" + shape[:12])), t
    store = Q.Tokens(frozenset(["ab"]), frozenset(["ba"]))
    for t in tokens[1:]:
        store.number[t]
    for t, row in zip(store.grow(), store.table, strict=False):
        word = Q.bare(t)
        assert row.tolist() == [bool(Q.RUN.search(t)), not any(map(str.isalnum, t)), t.endswith("!!"), sum(map(str.isalpha, t)), sum(map(str.isupper, t)), sum(map(str.isdigit, t)), len(t), word in Q.INSULTS, word == "ab", word[:5] == "ba"], t


def test_a_sample_in_many_partitions_is_trained_in_few(spark):
    rows = [(0, i % 2, [0, 1, 2, 3, 4, 5, 6, 7, 100 + i % 2, 200, 300]) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, y int, slots array<int>").repartition(2, "y").select("k", "y", "slots")
    many = df.filter("y = 0").repartition(20).union(df.filter("y = 1").repartition(20))
    assert many.rdd.getNumPartitions() >= 40
    scorer = Q.train_linear(many, 1)[0]
    assert np.abs(scorer.weights).max() > 0 and scorer.weights[101] > scorer.weights[100]


def test_new_tokens_are_looked_at_in_blocks_of_texts(monkeypatch):
    draw = random.Random(5)
    texts = [None, "", *[" ".join("".join(draw.choice("abzABZ09.,!?_-éÉßǅ中ªⅷ²'") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 40))) for _ in range(300)]]
    tokens = sorted({t for x in texts if x for t in x.split()})
    assert Q.slots_of(tokens).tolist() == [list(Q.token_slots(t)) for t in tokens]
    monkeypatch.setattr(Q, "BLOCK", 1000)
    monkeypatch.setattr(Q, "CACHED", 2000)
    store, seen, blocks = Q.Tokens(frozenset(), frozenset()), [], 0
    for block, new in store.numbered(pa.array(texts)):
        assert len(store.number) == store.used and set(new) <= set(store.number)
        names = list(store.number)
        seen += [" ".join(names[i] for i in ids) for ids in block]
        blocks += 1
    assert seen == [x or "" for x in texts] and 1 < blocks < 20 and len(store.number) < 4000
