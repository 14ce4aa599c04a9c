"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from orbitmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", registry.CASES)
def test_query_equals_its_sql(spark, db, name):
    query, text = registry.CASES[name]
    got = query(spark, SF).toPandas()
    expected = db.sql(text).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_entry_is_the_known_top_node(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark).orderBy("rank").first()
    assert (first["node_id"], first["score"]) == (144, 0.106627)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
