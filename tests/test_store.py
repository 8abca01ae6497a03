"""Corpus store semantics on small frames."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions import text
from lexloom.operators import store
from lexloom.plans import store_queries
from lexloom.session import (
    broadcast_if_small,
    drop_run_folder,
    durable,
    run_folder,
    scratch_path,
    stored_bytes,
)
from lexloom.sources import cache, catalog, corpus

FILE_A = '#!/usr/bin/env python3\n\nprint("Hello World")\n'
FILE_B = FILE_A + "\n"


def code(spark, rows):
    """rows: (id, language, url, content)"""
    frame = spark.createDataFrame(rows, "id long, language string, url string, content string")
    content = F.col("content")
    return frame.withColumns(
        {"hash": text.content_hash(content), "size": text.byte_length(content)}
    )


def progress(spark, rows):
    return spark.createDataFrame(rows, "language string, query string, last_page long")


def test_hashes_and_sizes(spark):
    frame = code(spark, [(1, "Python", "a", FILE_A), (2, "Python", "b", FILE_B)])
    rows = frame.withColumn("blob", text.blob_id(F.col("content"))).orderBy("id").collect()
    assert [(r.size, r.hash, r.blob) for r in rows] == [
        (45, "33ebb0946e5bb6932c9a8f2e9c4451a98eeac9c4", "b11fb8aba8c899f84c46293f4f037b8bbb7e8a86"),
        (46, "d87989444587b58a84282e0ecb81f12a5333aa60", "8283014bf077f4b347c28484cc0cf05d45f390b0"),
    ]


def test_duplicate_hash_keeps_first_url(spark):
    batch = code(
        spark,
        [(2, "Python", "http://localhost/main3.py", FILE_A), (1, "Python", "http://localhost/main.py", FILE_A)],
    )
    (row,) = store.insert_or_ignore(batch, code(spark, [])).collect()
    assert row.url == "http://localhost/main.py"


def test_stored_hash_is_ignored(spark):
    stored = code(spark, [(1, "Python", "a", FILE_A)])
    batch = code(spark, [(9, "Python", "z", FILE_A), (10, "Python", "y", FILE_B)])
    assert [r.url for r in store.insert_or_ignore(batch, stored).collect()] == ["y"]
    assert store.already_stored(batch, stored).count() == 1
    assert store.already_stored(batch, code(spark, [])).count() == 0


def test_counts_and_byte_totals(spark):
    languages = spark.createDataFrame([("Python",), ("C#",)], "language string")

    def totals(rows):
        return dict(store.bytes_by_language(code(spark, rows), languages).collect())

    both = [(1, "Python", "a", FILE_A), (2, "Python", "b", FILE_B)]
    assert totals([]) == {"Python": 0, "C#": 0}
    assert totals(both[:1]) == {"Python": 45, "C#": 0}
    assert totals(both) == {"Python": 91, "C#": 0}
    assert store.count_files(code(spark, [])).first().row_count == 0
    assert store.count_files(code(spark, both)).first().row_count == 2


def test_progress(spark):
    item = spark.createDataFrame([("Python", "web")], "language string, query string")
    history = "language string, query string, last_page long, seq long"

    def resume(writes):
        rows = [("Python", "web", page, n) for n, page in enumerate(writes)]
        stored = store.latest_progress(spark.createDataFrame(rows, history))
        return store.last_page(item, stored).first().last_page

    assert resume([]) == 0
    assert resume([50]) == 50
    assert resume([50, 42]) == 42


def test_open_work(spark):
    items = spark.createDataFrame(
        [("Go", "web"), ("Go", ""), ("Go", "done"), ("Go", "new")], "language string, query string"
    )
    stored = progress(spark, [("Go", "web", 3), ("Go", "done", -1)])
    found = {r.query: r.last_page for r in store.open_work(items, stored).collect()}
    assert found == {"web": 3, "new": 0}


@pytest.mark.parametrize("directory", ["", "test/", "/.test/"])
def test_extensions(spark, directory):
    rows = [(1, "Python", f"{directory}main.py", "x"), (2, "Python", f"{directory}main.c", "x")]
    assert [r.id for r in store.allowed_extensions(code(spark, rows)).collect()] == [1]


def test_extension_corner_cases(spark):
    rows = [
        (1, "C++", "a.C", "x"), (2, "C", "a.C", "x"), (3, "Python", "py", "x"),
        (4, "Python", "a.PY", "x"), (5, "Go", "a.py.go", "x"), (6, "Python", "a.d/py", "x"),
    ]
    found = {r.id for r in store.allowed_extensions(code(spark, rows)).collect()}
    assert found == {1, 5}


def test_canonical_languages(spark):
    names = [(name,) for name, _, _ in schema.LANGUAGES] + [("GoLang",), ("cobol",)]
    frame = store.canonical_language(spark.createDataFrame(names, "alias string"))
    found = dict(frame.select("alias", "language").collect())
    assert found.pop("GoLang") == "Go" and found.pop("cobol") is None
    assert all(alias == language for alias, language in found.items())


def test_size_cap_is_inclusive(spark):
    cap = schema.MAX_FILE_BYTES
    rows = [(1, "Go", "a", "x" * cap), (2, "Go", "b", "x" * (cap + 1)), (3, "Go", "c", "é" * (cap // 2 + 1))]
    frame = code(spark, rows)
    assert [r.id for r in store.within_size(frame).collect()] == [1]
    assert store.within_size(frame, 0).count() == 3


def test_merge(spark):
    target = code(spark, [(1, "Go", "a", "one"), (7, "Go", "b", "two")])
    source = code(spark, [(1, "Go", "c", "two"), (2, "Go", "d", "three"), (3, "Go", "e", "three"), (4, "Go", "f", "four")])
    once = store.merge_corpora(target, source)
    assert {(r.id, r.url) for r in once.collect()} == {(1, "a"), (7, "b"), (8, "d"), (9, "f")}
    twice = store.merge_corpora(once, source)
    assert sorted(twice.collect()) == sorted(once.collect())


def test_merge_keeps_rows_apart_that_share_keys(spark):
    target = code(spark, [(5, "Go", "a", "one")])
    rows = [(2, "Go", "c", "two"), (2, "Go", "c", "two"), (2, "Go", "d", "three"), (1, "C", "e", None), (9, "Go", "f", "one")]
    merged = sorted((r.id, r.url) for r in store.merge_corpora(target, code(spark, rows)).collect())
    assert [name for name, _ in merged] == [5, 6, 7, 8]
    assert sorted(url for _, url in merged) == ["a", "c", "d", "e"]


def test_numbering_sorts_once(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("x"), F.lit("y").alias("text"))
    plans, plain = [], store.durable
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store, "durable", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or plain(df, name))
        numbered = store.dense_index(frame, [F.col("x")], "n", 10)
    first = plans[0].split("== Physical Plan ==")[1]
    assert first.count("Exchange rangepartitioning") == 1 and first.count("Sort [") == 1
    last = numbered._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # The offsets of the files are all that is sorted and shuffled again.
    assert "rangepartitioning" not in last and last.count("Sort [") == 1 and "BroadcastHashJoin" in last
    rows = numbered.collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.x)] == list(range(10, 1010))


def test_rejects_have_a_reason(spark):
    rows = [
        (1, "py3", "a.py", 5), (2, "cobol", "b.py", 5), (3, None, "c.py", 5), (4, "CPP", "d.py", 5), (5, "golang", "e", 5),
        (6, "golang", "f.go", 50), (7, "golang", "g.go", 10), (8, "cobol", "h", 50),
    ]
    files = spark.createDataFrame(rows, "id long, alias string, url string, size long")
    found = store.sort_out(files, 10)
    assert sorted(r.id for r in found.good.collect()) == [1, 7]
    assert {r.id: r.reason for r in found.rejects.collect()} == {
        2: "language", 3: "language", 4: "extension", 5: "extension", 6: "size", 8: "language",
    }
    assert found.counts == {"files": 8, "language": 3, "extension": 2, "size": 1}
    assert store.with_reason(files, 0).where("reason = 'size'").count() == 0


def test_merge_progress_takes_the_source(spark):
    target = progress(spark, [("Go", "web", 9), ("Go", "cli", 1)])
    source = progress(spark, [("Go", "web", 3), ("C", "os", 2)])
    found = {(r.language, r.query): r.last_page for r in store.merge_progress(target, source).collect()}
    assert found == {("Go", "web"): 3, ("Go", "cli"): 1, ("C", "os"): 2}


def test_budget_is_checked_before_each_page(spark):
    rows = [(n, "Go", str(n), "x" * 10) for n in range(8)] + [(100 + n, "C", str(n), "x") for n in range(8)]
    files = code(spark, rows).withColumn("page", F.floor(F.col("id") % 100 / 2))
    kept = store.within_budget(files, 25)
    assert sorted(r.id for r in kept.where("language = 'Go'").collect()) == [0, 1, 2, 3]
    assert kept.where("language = 'C'").count() == 8
    assert store.within_budget(files, 0).count() == 16


def test_budget_over_several_blocks_of_pages(spark):
    rows = [("Go", page, 1) for page in range(100)]
    files = spark.createDataFrame(rows, "language string, page long, size long")
    for budget in (1, 7, 50, 99, 100, 1000):
        (row,) = store.pages_within_budget(files, budget, block=7).collect()
        assert row.cut_page == min(budget, 100) - 1


def test_dense_index_equals_sorting(spark):
    words = [f"w{n * 7919 % 1000:04d}" for n in range(1000)]
    frame = spark.createDataFrame([(w,) for w in words], "token string")
    found = dict(store.dense_index(frame, [F.col("token")], "idx").collect())
    assert found == {w: n for n, w in enumerate(sorted(words))}


def test_rank_within(spark):
    frame = spark.createDataFrame([("a" if n % 3 else "b", n) for n in range(200)], "k string, n long")
    found = store.rank_within(frame, "k", "n", "r", block=16).collect()
    for key in "ab":
        numbers = sorted(r.n for r in found if r.k == key)
        assert {r.n: r.r for r in found if r.k == key} == {n: i + 1 for i, n in enumerate(numbers)}


def test_text_helpers(spark):
    frame = spark.createDataFrame(
        [("0",), ("1700000000",), ("-1",), ("+5",), ("abc",), ("1.5",), (" 1",), ("99999999999999999999",)], "s string"
    )
    found = dict(frame.select("s", text.epoch_text(F.col("s"))).collect())
    assert found["0"] == "1970-01-01 00:00:00" and found["1700000000"] == "2023-11-14 22:13:20"
    assert found["-1"] == "1969-12-31 23:59:59" and found["+5"] == "1970-01-01 00:00:05"
    for same in ("abc", "1.5", " 1", "99999999999999999999"):
        assert found[same] == same


def test_labels(spark):
    frame = spark.createDataFrame([("C++_if",), ("STRING_LITERAL",), ("a_b_c",), ("x",)], "t string")
    token = F.col("t")
    rows = frame.select("t", text.label_language(token), text.label_keyword(token)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == {
        "C++_if": ("C++", "if"), "STRING_LITERAL": ("STRING", "LITERAL"), "a_b_c": ("", "a_b_c"), "x": ("", "x"),
    }


def test_catalog(spark):
    assert not catalog.table_exists(spark, "t1_code")
    location = scratch_path(spark, "catalog")
    catalog.create_tables(spark, location, "t1_")
    catalog.create_tables(spark, location, "t1_")
    try:
        assert catalog.table_exists(spark, "t1_code") and catalog.table_exists(spark, "t1_progress")
        assert not catalog.table_exists(spark, "doesnotexist")
        catalog.append_rows(code(spark, [(1, "Go", "a", FILE_A * 100)]), "t1_code")
        assert spark.table("t1_code").first().content == FILE_A * 100
        batch = [(2, "Go", "b", FILE_A), (3, "Go", "c", FILE_A), (4, "Go", "d", FILE_A * 100)]
        for _ in range(2):
            catalog.insert_new_files(code(spark, batch), "t1_code")
        assert {r.url for r in spark.table("t1_code").collect()} == {"a", "b"}
    finally:
        catalog.drop_tables(spark, "t1_")
    assert not catalog.table_exists(spark, "t1_code")
    catalog.drop_tables(spark, "t1_")


def test_intermediate_results_are_kept_together_and_dropped(spark):
    kept = durable(spark.range(3), "kept")
    assert all(run_folder(spark) in path for path in kept.inputFiles())
    drop_run_folder(spark)
    assert durable(spark.range(3), "again").count() == 3


def test_broadcast_only_within_the_limit(spark):
    stored = durable(spark.range(1000), "side")
    small, large = broadcast_if_small(stored), broadcast_if_small(stored, stored_bytes(stored) - 1)
    hinted = [df._jdf.queryExecution().analyzed().toString() for df in (small, large)]
    assert "ResolvedHint" in hinted[0] and "ResolvedHint" not in hinted[1]


def test_database_layouts(spark):
    older = spark.createDataFrame([("Go", "x")], "language string, snippet string")
    older.createOrReplaceTempView("snippets")
    try:
        assert corpus.read_database(spark).collect() == [("Go", "x")]
        code(spark, [(1, "C", "a", "y"), (2, "Go", "b", "z")]).createOrReplaceTempView("code")
        progress(spark, []).createOrReplaceTempView("progress")
        assert corpus.read_database(spark, "C").collect() == [("C", "y")]
    finally:
        for name in ("snippets", "code", "progress"):
            spark.catalog.dropTempView(name)


def test_cache_is_reused(spark):
    path = scratch_path(spark, "cache")
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "Go", ["a"])], "doc_id long, language string, tokens array<string>")

    for _ in range(2):
        assert cache.stored_or_built(spark, path, build).count() == 1
    assert len(built) == 1
    cache.stored_or_built(spark, path, build, use_cache=False)
    assert len(built) == 2


def test_ingest_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.py").write_bytes("é = 1".encode())
    (tmp_path / "deep" / "b.py").write_bytes(b"\xff\xfe")
    (tmp_path / "c.py").write_bytes(b"x" * 300)
    (tmp_path / "d.txt").write_bytes(b"x")
    rows = corpus.ingest_files(spark, str(tmp_path), pattern="*.py", cap=299).collect()
    assert {r.url.rsplit("/", 1)[1]: (r.content, r.size) for r in rows} == {
        "a.py": ("é = 1", 6), "b.py": (None, None),
    }
    assert [r.reject for r in rows if r.content is None] == ["not UTF-8"]
    latin = corpus.ingest_files(spark, str(tmp_path), "ISO-8859-1", "b.py").first()
    assert (latin.content, latin.size) == ("ÿþ", 4)


def test_size_cap_counts_decoded_text(spark, tmp_path):
    (tmp_path / "wide.py").write_bytes(("a" * 250).encode("utf-16"))
    (tmp_path / "latin.py").write_bytes("é".encode("latin-1") * 200)
    wide = corpus.ingest_files(spark, str(tmp_path), "UTF-16", "wide.py", cap=299).collect()
    assert [(r.content, r.size) for r in wide] == [("a" * 250, 250)]
    assert corpus.ingest_files(spark, str(tmp_path), "ISO-8859-1", "latin.py", cap=299).count() == 0


def test_malformed_files_are_rejected_one_by_one(spark):
    rows = [
        ("US-ASCII", b"abc", "abc"),
        ("US-ASCII", b"a\xe9c", None),
        ("UTF-16", "a\U0001f600é".encode("utf-16"), "a\U0001f600é"),
        ("UTF-16BE", b"\xd8\x00\x00a", None),
        ("UTF-16LE", b"\x00\xdca\x00", None),
        ("UTF-16LE", "\U0001f600".encode("utf-16-le"), "\U0001f600"),
        ("UTF-16", b"\xff\xfea", None),
        ("UTF-32", "é".encode("utf-32-be"), "é"),
        ("UTF-32", b"\x00\x11\x00\x00", None),
        ("KOI8-R", b"abc", None),
        ("utf8", b"", ""),
        ("UTF-16BE", ("x\U0001f600" * 50_000).encode("utf-16-be"), "x\U0001f600" * 50_000),
    ]
    frame = spark.createDataFrame([(n, c, b) for n, (c, b, _) in enumerate(rows)], "n int, charset string, content binary")
    found = frame.select("n", text.decoded(F.col("content"), F.col("charset")).alias("t")).orderBy("n").collect()
    assert [r.t for r in found] == [want for _, _, want in rows]


def test_blank_hashes_are_taken_from_the_content(spark):
    rows = [(1, "a", ""), (2, "b", None), (3, "a", "  "), (4, "c", "h"), (5, "d", "h")]
    frame = spark.createDataFrame(rows, "id long, content string, hash string")
    assert sorted(r.id for r in store.first_arrivals(frame).collect()) == [1, 2, 4]


def test_epoch_text_beyond_four_digit_years(spark):
    frame = spark.createDataFrame([("253402300800",), ("0" * 30 + "5",), ("9" * 18,)], "s string")
    found = dict(frame.select("s", text.epoch_text(F.col("s"))).collect())
    assert found == {
        "253402300800": "10000-01-01 00:00:00",
        "0" * 30 + "5": "1970-01-01 00:00:05",
        "9" * 18: "9" * 18,
    }


def test_raw_files_are_written_by_many_tasks(spark, tmp_path):
    """Short pages are not folded into one task that would write all files."""
    rows = [(n, f"<p>{n}</p>") for n in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = store_queries.s08(spark, str(tmp_path))
    assert len({path.rsplit("part-", 1)[1][:5] for path in found.inputFiles()}) > 1
    assert {row.page_id: row.size for row in found.where("page_id < 60").collect()} == {n: len(h) + 1 for n, h in rows[:60]}


def test_raw_files_lie_in_few_folders_and_are_read_by_few_tasks(spark, tmp_path):
    """Work grows with the pages and not with folders, processes or tasks for each of them; a repeated page is one file."""
    rows = [(n, f"<p>{n}</p>") for n in range(120)] + [(7, "<p>7</p>"), (200, "\u00e9\nx"), (None, "a"), (-3, "b"), (201, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = store_queries.s08(spark, str(tmp_path))
        got = {row.page_id: (row.hash, row.size) for row in found.collect()}
        cores = spark.sparkContext.defaultParallelism
        assert len({path.rsplit("/", 1)[0] for path in found.inputFiles()}) <= 3 * cores
        assert found.rdd.getNumPartitions() <= 3 * cores < len(found.inputFiles()) == 124
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    texts = {n: html + "\n" for n, html in rows if html} | {7: "<p>7</p>\n" * 2, 201: "\n"}
    assert got == {n: (hashlib.sha1(t.encode()).hexdigest(), len(t.encode())) for n, t in texts.items()}
