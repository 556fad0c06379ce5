"""Every registered query has a callable; SQL-backed ones match at the smallest scale for a sample of areas."""

import duckdb
import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SAMPLE = ["prep.bars", "TREND_EMA_V1", "rule.cross", "gate.failures", "rep.batch", "led.leaderboard", "win.contiguous", "smp.risk_samples", "cv.pbo"]


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert len(entry_mod.queries()) > 250


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_mod.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry_mod.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert entry_mod.entry(spark).count() == 3
