"""Exact nearest vectors: results against all pairs, and how many blocks are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import pivots

WIDE = "token string, vec array<double>"


def units(x):
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def expected(rows, queries, topn):
    tokens = sorted(rows)
    matrix = np.array([rows[t] for t in tokens])
    found = {}
    for name, (vec, banned) in queries.items():
        scores = np.rint(matrix @ vec * 1e6).astype(int)
        order = sorted((-int(s), t) for s, t in zip(scores, tokens) if t not in (banned or []))
        found[name] = [(t, -s) for s, t in order[:topn]]
    return found


def searched(spark, rows, queries, topn):
    frame = spark.createDataFrame([(t, list(map(float, v))) for t, v in rows.items()], WIDE)
    asked = spark.createDataFrame(
        [(name, list(map(float, vec)), banned) for name, (vec, banned) in queries.items()],
        "query string, vec array<double>, excluded array<string>",
    )
    found = {name: [] for name in queries}
    for row in pivots.nearest(asked, frame.repartition(3), topn).orderBy("query", "rank").collect():
        found[row.query].append((row.token, round(row.score * 1e6)))
    return found


def clustered(seed, clusters, each, size=16, width=0.02):
    rng = np.random.default_rng(seed)
    centres = units(rng.normal(size=(clusters, size)))
    return units(np.repeat(centres, each, axis=0) + width * rng.normal(size=(clusters * each, size)))


@pytest.mark.parametrize("block, group, topn", [(4096, 65536, 3), (7, 5, 10), (64, 3, 1)])
def test_equals_all_pairs(spark, monkeypatch, block, group, topn):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivots, "GROUP_ROWS", group)
    monkeypatch.setattr(pivots, "PIVOT_ROWS", 12)
    rng = np.random.default_rng(topn)
    x = np.concatenate([clustered(1, 12, 8), units(rng.normal(size=(60, 16))), np.zeros((2, 16))])
    x = np.concatenate([x, np.repeat(x[5:6], 80, axis=0), -x[:3]])
    rows = {f"t{n:04d}": v for n, v in enumerate(x)}
    queries = {t: (v, [t]) for t, v in list(rows.items())[::3]}
    queries |= {"free": (units(rng.normal(size=(1, 16)))[0], None), "zero": (np.zeros(16), []), "most": (x[0], list(rows)[:250])}
    assert searched(spark, rows, queries, topn) == expected(rows, queries, topn)


def test_without_vectors_or_with_zero_ones_only(spark):
    queries = {"q": (np.array([1.0, 0.0]), []), "z": (np.zeros(2), ["b"])}
    rows = {"a": np.zeros(2), "b": np.zeros(2)}
    assert searched(spark, rows, queries, 5) == expected(rows, queries, 5)
    none = spark.createDataFrame([], WIDE)
    asked = spark.createDataFrame([("q", [1.0, 0.0], [])], "query string, vec array<double>, excluded array<string>")
    assert pivots.nearest(asked, none).count() == 0
    assert pivots.nearest(asked.limit(0), spark.createDataFrame([("a", [1.0, 0.0])], WIDE)).count() == 0


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Of 40 tight clusters a query meets few blocks, and the rest of the pairs are never made."""
    monkeypatch.setattr(pivots, "PIVOT_ROWS", 50)
    x = clustered(2, 40, 50)
    frame = spark.createDataFrame([(f"t{n:04d}", v.tolist()) for n, v in enumerate(x)], WIDE)
    stored, blocks = pivots.blocks_of(frame)
    queries = stored.select(F.col("token").alias("query"), "vec", F.array("token").alias("excluded"))
    home = pivots.home_blocks(queries, blocks, 5)
    wanted = home.select("query", "vec", "excluded", F.explode("met").alias("block"))
    first = pivots.ranked(pivots.met(wanted, stored, blocks, 5), 5)
    least = first.where("rank = 5").select("query", F.col("score").alias("least"))
    more = pivots.further_blocks(home.join(least, "query"), blocks)
    pairs = sum(int(blocks.rows[b]) for row in home.collect() for b in row["met"])
    pairs += sum(int(blocks.rows[b]) for row in more.collect() for b in row["blocks"])
    assert pairs < 0.1 * len(x) ** 2
    plan = first._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_query_is_sent_once_to_a_shelf(spark):
    """Vectors without structure meet all blocks, but travel once for each shelf and come back once."""
    x = units(np.random.default_rng(6).normal(size=(3000, 8)))
    frame = spark.createDataFrame([(f"t{n:04d}", v.tolist()) for n, v in enumerate(x)], WIDE)
    stored, blocks = pivots.blocks_of(frame)
    many = len(blocks.rows)
    queries = stored.limit(50).select(F.col("token").alias("query"), "vec", F.array().cast("array<string>").alias("excluded"))
    every = queries.withColumn("blocks", F.array(*[F.lit(n) for n in range(many)]))
    shelves = pivots._shelves(blocks, pivots._room(blocks, 8))
    assert 1 < shelves.max() + 1 <= 4 < many
    sent = every.mapInArrow(
        pivots._by_shelf(shelves), "query string, vec array<double>, excluded array<string>, shelf int, blocks array<int>"
    )
    assert sent.count() == 50 * (shelves.max() + 1)
    assert sum(len(row["blocks"]) for row in sent.collect()) == 50 * many
    assert pivots.met_lists(every, stored, blocks, 1).count() <= 50 * (shelves.max() + 1)


def test_bounds_hold():
    x = np.concatenate([clustered(3, 5, 20), np.zeros((1, 16))])
    chosen = pivots.spread_pivots(x[:-1], 7)
    assert len(chosen) == 7
    block = np.append((x[:-1] @ chosen.T).argmax(axis=1), 7)
    angle = np.append(np.arccos(np.clip((x[:-1] @ chosen.T).max(axis=1), -1, 1)), 0)
    blocks = pivots.Blocks(
        chosen, np.array([angle[block == b].max(initial=0) for b in range(8)]), np.bincount(block, minlength=8)
    )
    queries = np.concatenate([x[::7], units(np.random.default_rng(4).normal(size=(20, 16))), np.zeros((1, 16))])
    bounds, scores = blocks.bounds(queries), queries @ x.T
    for b in range(8):
        assert (scores[:, block == b].max(axis=1) <= bounds[:, b] + 1e-9).all()
