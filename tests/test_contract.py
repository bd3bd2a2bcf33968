"""The driver's contract, and every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from accentweave import queries as engine

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["doc_id", "accentuated"] and out.count() == 200


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(engine.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, name):
    got = engine.queries()[name](spark, DATA).toPandas()
    assert len(got)
    sql = engine.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        flat = [frame[columns].astype(str).sort_values(columns).reset_index(drop=True) for frame in (got, want)]
        assert flat[0].equals(flat[1])
