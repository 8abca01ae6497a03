"""Streamed ingest equals the batch operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import store
from lexloom.session import scratch_path
from lexloom.streaming import history
from lexloom.streaming.ingest import FETCHED, Ingest


def fetched(spark, rows):
    """rows: (id, language, url, content, query, page)"""
    frame = spark.createDataFrame(
        rows, "id long, language string, url string, content string, query string, page long"
    )
    content = F.col("content")
    return frame.withColumns(
        {"hash": text.content_hash(content), "size": text.byte_length(content)}
    ).select(FETCHED.names)


ROWS = [
    # Copies stay within a language: a file dropped for its language's budget is
    # not stored, so a copy of it in another language would be new.
    (n, "Go" if n % 3 else "Python", f"f{n}.{'go' if n % 3 else 'py'}", f"{n % 3 > 0} {n % 11:02d}", "web", n // 4)
    for n in range(40)
]


def run_in_batches(spark, rows, size, budget=0):
    path = scratch_path(spark, "in")
    ingest = Ingest(spark, scratch_path(spark, "out"), budget)
    for start in range(0, len(rows), size):
        fetched(spark, rows[start : start + size]).coalesce(1).write.mode("append").parquet(path)
        ingest.start(path).awaitTermination()
    return ingest, path


def test_dedup_over_batches_equals_batch(spark):
    ingest, path = run_in_batches(spark, ROWS, 12)
    expected = store.first_arrivals(store.within_size(store.allowed_extensions(fetched(spark, ROWS))))
    assert sorted(r.url for r in ingest.code().collect()) == sorted(r.url for r in expected.collect())
    before = ingest.code().count()
    ingest.start(path).awaitTermination()
    assert ingest.code().count() == before


def test_replayed_batch_changes_nothing(spark):
    ingest, _ = run_in_batches(spark, ROWS, 20)
    before = sorted(ingest.code().collect()), sorted(ingest.bytes_stored().collect())
    ingest.store(fetched(spark, ROWS[20:]), 1)
    assert (sorted(ingest.code().collect()), sorted(ingest.bytes_stored().collect())) == before


def test_budget_over_batches_equals_batch(spark):
    budget = 45
    ingest, _ = run_in_batches(spark, ROWS, 8, budget)
    fresh = store.first_arrivals(fetched(spark, ROWS))
    expected = store.within_budget(fresh, budget)
    assert sorted(r.url for r in ingest.code().collect()) == sorted(r.url for r in expected.collect())
    totals = dict(expected.groupBy("language").agg(F.sum("size")).collect())
    assert dict(ingest.bytes_stored().collect()) == totals


def test_progress_takes_the_last_batch(spark):
    rows = [(1, "Go", "a.go", "x", "web", 7), (2, "Go", "b.go", "y", "web", 3), (3, "C", "c.c", "z", "os", 1)]
    ingest, _ = run_in_batches(spark, rows, 1)
    found = {(r.language, r.query): r.last_page for r in ingest.progress().collect()}
    assert found == {("Go", "web"): 4, ("C", "os"): 2}


def test_several_files_in_one_run(spark):
    path = scratch_path(spark, "in")
    fetched(spark, ROWS).repartition(4).write.parquet(path)
    ingest = Ingest(spark, scratch_path(spark, "out"))
    ingest.start(path, files_per_trigger=1).awaitTermination()
    hashes = [r.hash for r in ingest.code().collect()]
    assert len(hashes) == len(set(hashes)) == len({r[3] for r in ROWS})


def test_pages_beyond_the_budget_wait(spark):
    rows = [(n, "Go", f"f{n}.go", f"{n:0100d}", "web", n) for n in range(10)]
    ingest, path = run_in_batches(spark, rows, 10, 300)
    assert ingest.code().count() == 3
    assert [r.last_page for r in ingest.progress().collect()] == [3]
    # A later run, even one without new files, goes on where the budget ended.
    later = Ingest(spark, ingest.root, 10**9)
    later.resume()
    assert sorted(r.id for r in later.code().collect()) == list(range(10))
    assert [r.last_page for r in later.progress().collect()] == [10]
    later.resume()
    assert later.code().count() == 10


def test_file_cap_can_be_lifted(spark):
    rows = [(1, "Go", "f.go", "x" * 300_000, "web", 0)]
    path = scratch_path(spark, "in")
    fetched(spark, rows).write.parquet(path)
    for cap, count in ((262_144, 0), (0, 1)):
        ingest = Ingest(spark, scratch_path(spark, "out"), cap=cap)
        ingest.start(path).awaitTermination()
        assert ingest.code().count() == count


def test_a_query_is_finished_when_its_pages_are_stored(spark):
    rows = [(n, "Go", f"f{n}.go", f"{n:0100d}", "web", n) for n in range(6)]
    end = [(None, "Go", None, None, "web", -1)]
    ingest, path = run_in_batches(spark, rows, 3, 400)
    assert [r.last_page for r in ingest.progress().collect()] == [4]
    fetched(spark, end).write.mode("append").parquet(path)
    ingest.start(path).awaitTermination()
    assert [r.last_page for r in ingest.progress().collect()] == [4]
    later = Ingest(spark, ingest.root, 10**9)
    later.resume()
    assert [r.last_page for r in later.progress().collect()] == [-1]
    assert later.code().count() == 6
    fetched(spark, [(None, "C", None, None, "os", -1)]).write.mode("append").parquet(path)
    later.start(path).awaitTermination()
    assert {(r.language, r.last_page) for r in later.progress().collect()} == {("Go", -1), ("C", -1)}


def test_filters_miss_no_stored_hash(spark, monkeypatch):
    rng = random.Random(5)
    for bits_per_hash in (16, 3_000):
        monkeypatch.setattr(history, "BITS_PER_HASH", bits_per_hash)
        past = history.History(spark, scratch_path(spark, "past"))
        stored, pool = {}, [f"{rng.getrandbits(160):040x}" for _ in range(900)]
        for batch, size in ((1, 200), (3, 0), (5, 90), (8, 1)):
            stored[batch] = rng.sample(pool, size)
            rows = [(h,) for h in stored[batch]] + [(None,)] + [(h,) for h in stored[batch][:9]]
            past.add(spark.createDataFrame(rows, "hash string"), batch)
        asked = rng.sample(pool, 500)
        frame = spark.createDataFrame([(h,) for h in asked] + [(None,)], "hash string")
        for numbers in ([1, 3, 5, 8], [3], [5, 8], []):
            known = {h for n in numbers for h in stored[n]}
            found = [r.hash for r in past.stored_among(frame, numbers).collect()]
            assert sorted(found) == sorted(known & set(asked))
        possible = {(r.hash, r.batch) for r in past.possible(frame, [1, 3, 5, 8]).collect()}
        true = {(h, n) for n, hashes in stored.items() for h in hashes if h in asked}
        assert true <= possible and len(possible) < len(true) + 20


def test_history_is_neither_shuffled_nor_read_whole(spark):
    past = history.History(spark, scratch_path(spark, "past"))
    for batch in (1, 3, 5):
        past.add(spark.range(2_000).select(F.sha1(F.concat(F.lit(f"{batch}:"), F.col("id").cast("string"))).alias("hash")), batch)
    asked = spark.createDataFrame([("3:7",)], "text string").select(F.sha1("text").alias("hash"))
    read = []
    plain = type(spark.read).parquet

    def recorded(self, *paths, **options):
        read.extend(p for p in paths if "/hashes/" in p)
        return plain(self, *paths, **options)

    plans = []
    stored = history.durable
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.read), "parquet", recorded)
        patch.setattr(history, "durable", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or stored(df, name))
        assert past.stored_among(asked, [1, 3, 5]).count() == 1
    assert read == [f"{past.hashes}/batch=3"]
    (plan,) = [text.split("== Physical Plan ==")[1] for name, text in plans if name == "stored"]
    assert "BroadcastHashJoin" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    # What is shuffled are the hashes found, after the join.
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin") and plan.count("Exchange hashpartitioning") == 1
