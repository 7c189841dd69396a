"""Queries against their DuckDB SQL on the smallest tables, and the driver's contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lakewarden.plans import catalog

DATA = "/root/testdata/sf0.001"
SOME = ["traffic_rollup", "forensic_search", "usage_metering", "chain_verify", "session_escalation", "histogram_quantile", "access_mediation", "replica_diff", "card_scan", "range_reference_check", "stream_dedup", "mmr_root", "mmr_verify", "mmr_root_v2", "hmac_verify", "siem_export", "jsonl_quarantine", "rule_scan", "stream_ema", "backup_manifest_diff", "phrase_scan", "mmr_append", "causal_root", "causal_order_check", "global_sequence_verify", "distribution_drift", "drift_responses", "range_claims", "code_claims", "quarantine_records", "stream_outcomes", "stream_correlate_near", "routing_monitor", "token_split_scan", "detector_scorecard", "evasion_campaign", "xsession_correlate", "export_lakehouse"]


def plain(v):
    return f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else "" if v is None else str(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    result = con.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    got = sorted(tuple(map(plain, r)) for r in catalog.QUERIES[name](spark, DATA).select(*names).collect())
    assert got == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
