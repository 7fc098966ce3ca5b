"""Registered queries against their SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

FOLDER = Path("/root/testdata/sf0.001")
NAMES = (
    "v1_timeline_vote",
    "v4_export_vote",
    "a1_threshold_mad",
    "w1_significance_and_percentile",
    "f5_significance_gate",
    "t11_clean_text",
    "p1_grouped_stratified_split",
    "x2_summary_metrics",
    "x10_regression_metrics",
    "w17_silence_regions",
    "r2_job_progress",
    "g3_build_funnel",
)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not FOLDER.exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    assert columns == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.skipif(not FOLDER.exists(), reason="driver tables absent")
def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
