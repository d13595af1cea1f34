"""Every registered query against its SQL oracle on sf0.001 (the driver's check, smaller)."""

import duckdb
import pytest

import __spark_entry__ as entry
from offerlake.plans.catalog import ORACLE_SQL, QUERIES
from tools.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    # an index answers all but exactly: its recall is tested in test_near_and_vectors
    assert set(QUERIES) - {"search_vectors_index"} == set(ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[1] == digest(ocols, res.fetchall())[1]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["source_id", "page", "url", "ingested_us", "must_have", "requirements_description",
                          "offer_description"]
