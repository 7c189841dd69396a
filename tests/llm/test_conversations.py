"""Conversation repair against a plain recursion over (row, state)."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, _k string, part int, cost double"


def brute_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, digest) of rows (role, text), from the back."""
    kinds, met = [], set()
    for role, text in rows:
        last = text.strip(WHITE)[-1:]
        kinds.append("B" if not last else "U" if (role, text) in met else "T" if last not in ".!?" else "")
        met.add((role, text))
    initials = [r[:1] for r, _ in rows]
    steps = {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}  # of (s?(ua)+)?

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in "03" else []
        if inserts < 3:
            for c in "ua":
                if c in steps[state]:
                    cost, audit, said = best(i, steps[state][c], inserts + 1)
                    ways.append((cost + 5, "I" + audit, ({"u": "user:", "a": "assistant:"}[c], *said)))
        if i < len(rows):
            cost, audit, said = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, said))
            if kinds[i] in ("", "T"):
                for c, name, price, edit in [(initials[i], rows[i][0], 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")]:
                    if c in steps[state]:
                        cost, audit, said = best(i + 1, steps[state][c], 0)
                        ways.append((cost + price + (5 if kinds[i] else 0), edit + audit, (f"{name}:{rows[i][1]}", *said)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, said = best(0, "0", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return kinds.count("B"), kinds.count("U"), kinds.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def brute_query(rows):
    """The query's rows from (conv_id, turn, role, text)."""
    left = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            left[conv] += [row] * (2 if h == 3 else 1)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(left[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *brute_repair([r[1:] for r in own])))
    return out


def conversations(seed, n, rows):
    pick = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(pick.randrange(1, rows)):
            role = pick.choice(["system" if not turn else "user", "user", "assistant", "user", "assistant", "tool", "uncle", None, ""])
            text = pick.choice([None, "", " \n", "Yes.", "Yes.", f"Word {pick.random()}.", f"Cut {pick.randrange(3)}", f"So? {turn}!\t", "é" * 50 + "."])
            out.append((conv, None if pick.random() < 0.03 else turn + (turn > 4), role, text))
    return [*out, (None, 1, "user", "Hm."), (None, None, "assistant", "Ho."), (-1, None, "user", "Hm.")]


def read(summary, parts):
    told = {r["conv_id"]: r["repaired_sha256"] for r in repair.repaired_digests(parts).collect()}
    return sorted(((r["conv_id"], r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], told[r["conv_id"]]) for r in summary.collect()), key=str)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_repair_equals_the_recursion(spark, chunk):
    rows = conversations(5, 60, 12)
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    got = read(*repair.repair_conversations(repair.damaged(df), chunk=chunk))
    want = [w for w in brute_query(rows) if w[5:8] != (0, 0, "") or w[0] in {g[0] for g in got}]
    assert got == sorted(want, key=str)


def test_chunks_of_a_hot_conversation_meet(spark):
    """One conversation with most rows, most of them equal: the same by chunks of 7 as at once."""
    pick = random.Random(9)
    rows = [(1, t, pick.choice(["user", "assistant"]), "Same." if pick.random() < 0.5 else f"Own {t % 90}.") for t in range(200)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    at_once, in_parts = read(*repair.repair_conversations(df)), read(*repair.repair_conversations(df, chunk=7))
    assert at_once == in_parts
    assert in_parts[0][1:8] == (0, *brute_repair([r[2:] for r in rows[:200]])[:6])


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    summary, parts = repair.repair_conversations(df)
    assert summary.count() == 0 and repair.repaired_digests(parts).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "A long text. " * 20_000, "x", 1, 0.5), (1, 0, "user", "A long text. " * 20_000, "x", 1, 0.5), (1, 1, "assistant", "B.", "x", 1, 0.5)], SCHEMA)
    row = repair.repair_conversations(twice)[0].first()
    assert (row["duplicate"], row["cost"], row["audit"]) == (1, 2, "KDK")


def test_query_has_every_conversation(spark, tmp_path):
    rows = conversations(7, 150, 3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted((tuple(r) for r in repair.op11_conversation_repair(spark, str(tmp_path)).select(*names).collect()), key=str)
    assert got == sorted(brute_query(rows), key=str)
    assert any(r[7] == "" for r in got)


def test_readings_of_a_stack_keep_the_grammar():
    """Whatever the edits, the repaired initials are of the grammar."""
    pick = random.Random(1)
    for _ in range(300):
        rows = [(pick.choice(["system", "user", "assistant", "tool"]), f"{pick.randrange(4)}{pick.choice(['.', '', '!'])}") for _ in range(pick.randrange(9))]
        steps = [(r[:1], f) for (r, _), f in zip(rows, repair.faults([(*r, False) for r in rows]), strict=True)]
        cost, audit = min(v for k, v in repair.readings(steps, (0,)).items() if repair.STACKS[k][-1] in repair.ACCEPTED)
        said = repair.lines(rows, audit, (0,))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(s[0] for s in said))
        assert (cost, audit) == brute_repair(rows)[4:6]


def test_damage_covers_all_kinds(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("text", "role").agg(F.count("*").alias("n")).collect()
    assert {(r["text"], r["role"]) for r in got} == {("One. Two!", "assistant"), ("", "assistant"), ("One Two", "assistant"), ("One. Two!", "user")}
