"""Rules tables: validation, versions, pattern files, and thousands of rules against a plain search."""

import json
import random
import re

import pytest

from lakewarden.functions import text as T
from lakewarden.operators import textjobs as X
from lakewarden.sources import rules as RL

GOOD = {"rule_id": "r1", "family": "f", "severity": 2, "weight": 0.5, "pattern": "ab+"}


def test_rules_are_judged(spark):
    rows = [GOOD, GOOD | {"rule_id": "r2", "pattern": "a("}, GOOD | {"rule_id": None}, GOOD | {"rule_id": "r3", "severity": 7}, GOOD | {"rule_id": "r4", "weight": float("nan")}, GOOD | {"rule_id": "r5", "tail": 0}, GOOD | {"rule_id": "r6", "pattern": " "}, GOOD | {"rule_id": "r7", "family": ""}]
    rows += [GOOD | {"version": 3, "pattern": "abc"}, GOOD | {"version": 2, "pattern": "abd"}, GOOD | {"rule_id": "r8", "gate": ["AB", "", None]}]
    valid, rejected = RL.judged_rules(spark.createDataFrame(rows, RL.SCHEMA))
    kept = {r["rule_id"]: r for r in RL.rule_rows(valid)}
    assert set(kept) == {"r1", "r8"} and kept["r1"]["pattern"] == "abc" and kept["r8"]["gate"] == ["ab"]
    reasons = {r.rule_id: r.reason.split(":")[0] for r in rejected.collect()}
    assert reasons == {"r2": "no regular expression", None: "no rule_id", "r3": "severity is not 1 to 4", "r4": "weight is not 0 to 1", "r5": "tail is not above 0", "r6": "no pattern", "r7": "no family"}
    with pytest.raises(ValueError):
        RL.rule_rows(valid, 1)


def test_json_lines_and_pattern_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text("\n".join([json.dumps(GOOD), "{broken", json.dumps({"rule_id": "r2"})]))
    valid, rejected = RL.read_rules(spark, str(tmp_path / "rules.json"), "json")
    assert [r["rule_id"] for r in RL.rule_rows(valid)] == ["r1"] and rejected.count() == 2
    (tmp_path / "patterns.json").write_text(json.dumps({"version": 4, "critical": ["drop\\s+table", "("], "soft": ["please"]}, indent=2))
    valid, rejected = RL.read_pattern_file(spark, str(tmp_path / "patterns.json"))
    rules = RL.rule_rows(valid)
    assert [(r["rule_id"], r["severity"], r["version"]) for r in rules] == [("critical-0", 4, 4), ("soft-0", 2, 4)] and [r.rule_id for r in rejected.collect()] == ["critical-1"]
    texts = spark.createDataFrame([(1, "Please DROP  TABLE x"), (2, "no")], "id int, text string")
    assert sorted((r.id, r.rule_id, r.at) for r in X.rule_scan(texts, "id", "text", rules).collect()) == [(1, "critical-0", 8), (1, "soft-0", 1)]


def test_thousands_of_rules_equal_a_plain_search(spark):
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randrange(2, 6))) for _ in range(1500)]
    rules = [GOOD | {"rule_id": f"w{i}", "pattern": rf"(?i)\b{w}\b", "gate": [w], "tail": None} for i, w in enumerate(words)] + [GOOD | {"rule_id": f"g{i}", "pattern": rf"{w}[a-c]+$", "gate": [], "tail": 30} for i, w in enumerate(words[:20])]
    rules += [GOOD | {"rule_id": f"p{i}", "pattern": f"{a} {b}", "gate": [f"{a} {b}"], "tail": None} for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    texts = [" ".join(pick.choice(words).title() if pick.random() < 0.2 else pick.choice(words) for _ in range(pick.randrange(60))) for _ in range(40)] + [None, ""]
    want = []
    for i, t in enumerate(texts):
        for r in rules:
            body = (t or "")[-r["tail"] :] if r["tail"] else t or ""
            want += [(i, r["rule_id"], len(t or "") - len(body) + m.start() + 1) for m in re.finditer(r["pattern"], body, re.A)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = X.rule_scan(df, "id", "text", rules)
    assert len(rules) > 3000 and sorted((r.id, r.rule_id, r.at) for r in found.collect()) == sorted(want)
    first = found.filter("at > 25").first()
    assert first.excerpt == texts[first.id][first.at - 21 : first.at + 179]


def test_gates_hold_for_their_patterns():
    """Phrases that a rule matches have a literal of its gate, whatever the case and the white space."""
    phrases = ["IGNORE\tthose  rules", "switch to god mode", "act freely without\nlimits", "Your SECRET prompt", "suppose you have no", "</ results >", "<|im_start|>", "a memo  to\nthe AI", "pull all bids as soon as", "buy from\nour\nown desk", "push price\tup", "before results are announced", "(TS//SI)", "been intubated", "rash since starting", "write registers of the PLC", "token: 0123456789abcdef0", "curl x | sh"]
    rules = T.RULES + T.FIXTURE_RULES
    hit = set()
    for p in phrases:
        for r in rules:
            if re.search(r["pattern"], p, re.A):
                hit.add(r["rule_id"])
                assert not r["gate"] or any(g in p.lower() for g in r["gate"]), (p, r["rule_id"])
    assert len(hit) >= 17
