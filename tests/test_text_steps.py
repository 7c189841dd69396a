"""Steps that texts pass once, or not at all where they need not."""

import re

import pandas as pd
from pyspark.sql import functions as F

from lakewarden.functions import text as T
from lakewarden.operators import claims as C
from lakewarden.operators import joins as J
from lakewarden.operators import textjobs as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_dealt_before_they_are_counted(spark):
    rows = spark.createDataFrame([(1, "K12.1")], "id int, text string")
    words = spark.createDataFrame([("heart", "I")], "keyword string, domain string")
    made = C.code_claims(rows, rows, "id", "text", r"\b[A-Z]\d{2}\.\d\b", F.substring("code", 1, 1), words)
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan(made))) <= 2  # the key words', shown once or twice; no side is joined by id
    assert "REPARTITION_BY_NUM" in plan(made) and [tuple(r) for r in made.collect()] == [(1, 1, "", False)]


def test_classes_that_need_a_digit_or_mark_are_asked_of_texts_that_have_one(spark):
    texts = ["no such thing", "Dr. Ann Lee, DEA ABCDEF and dead:beef:cafe:1", "ab:cd:ef", "write to a.b@c.org", "https://x.y/z", "call 555-123-4567 or 10.0.0.1", "[REDACTED:URL] fingerprint", "a" * 40, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for label, pattern in T.IDENTIFIERS:
        plain = F.regexp_replace(plain, T.ascii_bounds(pattern), f"[REDACTED:{label}]")
    assert all(r.a == r.b for r in df.select(T.redact(F.col("text")).alias("a"), plain.alias("b")).collect())
    assert "[0-9@:]" in df.select(T.redact(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_ascii_texts_do_not_go_to_python(spark, monkeypatch):
    @F.pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "python" if t.isascii() else "wide")

    monkeypatch.setattr(X, "compatible", composed)
    df = spark.createDataFrame([("Plain",), ("ｗ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.deobfuscate(F.col("t"))).collect()] == ["plain", "wide", None, ""]


def test_bundles_are_parsed_once(spark):
    written = []

    def stored(df):
        written.append(df.columns)
        return df.localCheckpoint()

    bundle = '{"objects": [{"type": "indicator", "id": "i1"}, {"type": "attack-pattern", "id": "a1"}, {"type": "relationship", "relationship_type": "indicates", "source_ref": "i1", "target_ref": "a1"}, {"type": "relationship", "relationship_type": "uses", "source_ref": "i1", "target_ref": "a2"}]}'
    out = J.stix_link(spark.createDataFrame([(bundle,)], "b string"), "b", stored)
    assert "from_json" not in plan(out).lower() and len(written) == 1
    assert [tuple(r) for r in out.collect()] == [("i1", "a1")]


def test_matches_are_sent_in_small_pieces(spark):
    import pyarrow as pa

    rule = {"rule_id": "r", "family": "f", "severity": 1, "weight": 0.5, "pattern": "x", "gate": ["x"], "tail": None}
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201)), pa.array(["x"] * 1201)], ["id", "text"])
    sent = list(X._matches([rule])(iter([batch])))
    assert [b.num_rows for b in sent] == [500, 500, 201] and [i for b in sent for i in b.column(0).to_pylist()] == list(range(1201))
