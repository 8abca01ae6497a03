"""Registered queries of the subpackage on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.llm.catalogue import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_check(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    names = sorted(found.columns)
    expected = con.sql(CHECKS[name]).df()
    assert names == sorted(expected.columns)
    got = sorted(str(tuple(r)) for r in found.select(names).collect())
    rows = expected[names].astype(object).where(expected[names].notna(), None)
    want = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows.itertuples(index=False, name=None)]
    integral = {n for n, kind in found.dtypes if kind in ("bigint", "int")}
    want = [tuple(int(v) if n in integral and v is not None else v for n, v in zip(names, row)) for row in want]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
