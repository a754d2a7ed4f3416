"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from pactum.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, list):
        return [plain(y) for y in x]
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con




@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = [[plain(v) for v in r.values()] for r in got.select(columns).toArrow().to_pylist()]
    want = [[plain(v) for v in r.values()] for r in duck.sql(ORACLES[name]).to_arrow_table().select(columns).to_pylist()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 10 and "check_id" in out.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
