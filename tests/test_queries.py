"""Every registered query against its SQL check on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 9) if isinstance(value, float) else value


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(_cell, row)) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((str(type(v)), str(v)) for v in row))


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_check(spark, con, name):
    found = entry.queries()[name](spark, SF).toPandas()
    expected = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


@pytest.mark.parametrize(
    "name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"e10_continue_prompts"})
)
def test_unchecked_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def test_word_map_has_every_vector(spark, con):
    """No label and no rank is left out of the map."""
    found = entry.queries()["e12_word_map"](spark, SF).select("language", "keyword", "x").collect()
    assert len(found) == con.sql("SELECT count(*) AS n FROM embeddings").fetchall()[0][0]
