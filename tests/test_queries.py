"""Spark and DuckDB side by side on the smallest tables, for one query of each family."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = pathlib.Path("/root/testdata/sf0.001")
SOME = ["panel_build", "walk_forward_metrics", "audit_perturbation", "leaderboard_tests", "context_gaps", "ui_confident_stats", "weights", "serving_split", "scan_panel", "run_store", "scan_bars", "validate_bars", "adjust_actions", "rate_window", "rsi", "features_volatility", "features_market", "targets", "kappa", "folds", "evaluate", "select_threshold", "wilcoxon_w", "perf_by_bucket", "near_reversal", "describe_states", "cost_sweep", "top_contributions", "config_hash"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    df = entry.queries()[name](spark, str(FOLDER))
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == want
