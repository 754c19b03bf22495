"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as entry
from annspark.plans.queries import QUERIES
from tests.conftest import SF001
from tools.check_oracle import TABLES, normalise

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF001).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert len(got) == len(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "label", "prediction", "n_candidates"]
    assert df.count() == 100
