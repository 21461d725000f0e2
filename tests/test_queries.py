"""Every query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as engine
from provgraph.plans import registry

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted(repr([(k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = [r.asDict(recursive=True) for r in engine.queries()[name](spark, SF).collect()]
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert rows(got) == rows(dict(zip(names, r, strict=True)) for r in cursor.fetchall())


def test_entry_has_rows(spark):
    assert engine.entry(spark).count() > 0
