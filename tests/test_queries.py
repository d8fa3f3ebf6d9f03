"""Every query with an SQL counterpart gives the same rows on DuckDB."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import rows
from ledgerline.plans.views import GIVEN

SF = "/root/testdata/sf0.001"
#: Fits and rewrites that take longer than the rest and are checked by check.py.
SLOW = {"out_of_fold_coverage", "baseline_prior"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["bin", "n", "n_events", "event_rate"] and df.count() == 10


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())
