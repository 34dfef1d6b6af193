"""A sample of the registered queries against their SQL twins; check_oracle.py runs them all."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import canonical

SF = "/root/testdata/sf0.001"
SAMPLE = ["session_summary_top3", "w3_pause_groups", "w7_w8_carve_spans", "w11_thin_events", "j1_lexicon_match",
          "j6_points_in_spans", "j10_near_duplicates", "k1_rank_candidates", "fn9_guess_language", "src2_parse_lrc",
          "st1_upsert", "str1_job_state", "str2_pause_groups"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = canonical(cur.fetchall(), [names.index(c) for c in cols])
    assert canonical(df.collect(), [df.columns.index(c) for c in cols]) == want and want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "user_id" and df.count() > 0
