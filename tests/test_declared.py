"""Masking by array passes against the window form in SQL."""

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from lexloom.operators import declared
from lexloom.plans.declared_sql import masked_sql

SOUP = {
    "C++": "int a b c Foo x1 = ; , ( ) { } [ ] * & && < > :: . ? const static for catch void if return INT_LITERAL -> unsigned",
    "C#": "int var string a b c Foo é @class = ; , ( ) { } [ ] < > . ? in foreach using fixed catch void INT_LITERAL => out",
    "Go": "var const a b c é Foo := = , ; ( ) { } [ ] * . func map chan ... range case for if struct <- \n \n INT_LITERAL",
    "Python": "a b c é self _ = += : , . ( ) [ ] * ** def lambda for in with as async if case except import class \n \n \n ; STRING_LITERAL else",
    "HTML": "a b = ; ( ) VARIABLE",
}


def soup(seed, files, longest):
    rng = random.Random(seed)
    rows = []
    for number in range(files):
        language = rng.choice([*SOUP, None])
        words = [w for w in SOUP[language or "HTML"].split(" ") if w]
        rows.append((number, language, [rng.choice(words) for _ in range(rng.randrange(longest))]))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_sql_form(seed):
    rows = soup(seed, 600, [4, 8, 15, 30, 60, 200][seed])
    kind = pa.list_(pa.string())
    found = declared._masked(pa.array([tokens for _, _, tokens in rows], kind), [language for _, language, _ in rows])
    table = pd.DataFrame(
        [(n, language, pos, token) for n, language, tokens in rows for pos, token in enumerate(tokens)],
        columns=["doc_id", "language", "pos", "token"],
    )
    con = duckdb.connect()
    con.register("tok", table)
    sql = masked_sql("tok", lambda column, pattern: f"regexp_matches({column}, '{pattern}')")
    want = con.sql(f"SELECT doc_id, pos, hidden FROM {sql} ORDER BY doc_id, pos").fetchall()
    got = [
        (n, pos, shown == "VARIABLE" and shown != plain)
        for (n, _, tokens), masked in zip(rows, found.to_pylist())
        for pos, (plain, shown) in enumerate(zip(tokens, masked, strict=True))
    ]
    assert sum(hidden for _, _, hidden in got) > 20 * (seed > 1)
    wrong = [(a, b, rows[a[0]]) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:2]


def test_null_and_empty_lists_and_small_chunks(monkeypatch):
    lists = [None, [], ["int", "a", ";"], None, ["a", "=", "a"], [], ["x"]]
    languages = ["C++", "Go", "C++", None, "Python", "Python", "Cobol"]
    expected = [None, [], ["int", "VARIABLE", ";"], None, ["VARIABLE", "=", "VARIABLE"], [], ["x"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 7), pa.array(languages), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "language", "tokens"]
    )
    for size in (1, 4, 1000):
        monkeypatch.setattr(declared, "CHUNK_TOKENS", size)
        parts = list(declared._batches(iter([batch, batch.slice(2, 3)])))
        shown = [tokens for part in parts for tokens in part.column("tokens").to_pylist()]
        assert shown == expected + expected[2:5]
    (only,) = declared._batches(iter([batch.slice(0, 2)]))
    assert only.column("tokens").to_pylist() == [None, []]


def test_rows_of_one_id_are_masked_alone(spark):
    rows = [(1, "C++", ["int", "a", ";"]), (1, "C++", ["a", "=", "b"]), (None, "C++", None)]
    frame = spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")
    found = [tuple(r) for r in declared.masked_tokens(frame).collect()]
    assert found == [(1, "C++", ["int", "VARIABLE", ";"]), (1, "C++", ["a", "=", "b"]), (None, "C++", None)]
