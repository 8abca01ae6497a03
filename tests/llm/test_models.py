"""Classifiers and neighbour search."""

import math
import random
import zlib

import numpy as np
import pytest

from lexloom.llm import neighbours, quality, toxicity, training
from tests.llm.fixtures import awkward_texts


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    pos = sum(labels)
    return (order[np.array(labels) == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def labelled(spark, bad, rows=600):
    rng = random.Random(2)
    docs, labels = [], []
    for n in range(rows):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 60))]
        marked = n % 4 == 0
        if marked:
            words = bad(words, rng)
        docs.append((n, " ".join(words), "a"))
        labels.append((n, int(not marked), int(marked)))
    docs += [(None, None, "b"), (None, "", "b"), (10**6, "x" * 200_000, None), (3, docs[3][1], "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "0.5 as score", "1 as y")
    return docs, frame, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    def bad(words, rng):
        words[rng.randrange(len(words))] = "NASTY,"
        return words

    docs, frame, labels = labelled(spark, bad)
    found = toxicity.score(frame, labels).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert auc([r.score for r in held], [int(r.doc_id % 4 == 0) for r in held]) > 0.95


def test_quality_on_held_out_documents(spark):
    docs, frame, labels = labelled(spark, lambda words, rng: [w.upper() + "!!" for w in words])
    found = quality.judged(frame, labels).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert auc([r.score for r in held], [int(r.doc_id % 4 != 0) for r in held]) > 0.95
    scored = quality.score(frame, labels)
    assert scored.columns == ["doc_id", "text", "source", "y", "score"]


def test_the_sample_is_bounded(spark, monkeypatch):
    """150,000 rows of one id, some of them long: one row each, and no more bytes than stated."""
    many = spark.range(150_000).selectExpr("7 as doc_id", "concat('text ', id) as text")
    others = spark.range(300).selectExpr("id + 100 as doc_id", "repeat('ab ', 100) as text")
    long = spark.createDataFrame([(8, "x" * 3_000), (9, None)], "doc_id long, text string")
    docs = many.unionByName(others).unionByName(long)
    labels = docs.select("doc_id").distinct().selectExpr("doc_id", "0 as toxic").unionByName(
        spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    )
    found = training.labelled_sample(docs, labels, "toxic", 10_000).collect()
    trained = [n for n in [7, 8, *range(100, 400)] if zlib.crc32(str(n).encode()) % 3 != 1]
    assert len(found) == len(trained) and len({r.order for r in found}) == len(found)
    assert sum(r.y for r in found) == sum(n == 7 for n in trained)
    monkeypatch.setattr(training, "TEXT_BYTES", 2_000)
    monkeypatch.setattr(training, "SAMPLE_BYTES", 6_000)
    some = training.labelled_sample(docs, labels, "toxic", 10_000).collect()
    assert 0 < sum(len(r.text) for r in some) <= 6_000
    assert {r.order for r in some} == set(sorted(r.order for r in found if len(r.text) <= 2_000)[: len(some)])


def test_models_without_rows(spark):
    _, frame, labels = labelled(spark, lambda words, rng: words, 8)
    for run in (toxicity.score, quality.judged):
        assert run(frame.limit(0), labels).count() == 0
        assert {r.score for r in run(frame, labels.limit(0)).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in quality.fresh_model().items()}
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 5, 700, 1500)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y = np.array([0, 1, 0, 1])

    def loss():
        z = quality.logits(model, data, offsets)
        return np.mean(np.logaddexp(0, z) - y * z)

    found = quality._gradients(model, data, offsets, y)
    for name in model:
        flat = model[name].reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            kept, step = flat[at], 1e-5
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            slope = (up - loss()) / (2 * step)
            flat[at] = kept
            assert found[name].reshape(-1)[at] == pytest.approx(slope, abs=1e-4)


def test_chunks_cover_whole_texts():
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    start, end, text = quality.chunk_starts(offsets)
    for n, size in enumerate(sizes):
        covered = set()
        for a, b in zip(start[text == n], end[text == n], strict=True):
            covered |= set(range(a, b))
        assert covered == set(range(offsets[n], offsets[n] + size))


def test_toxicity_scores_awkward_texts(spark):
    frame = spark.createDataFrame(awkward_texts(), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame, labels).count() == frame.count()


# --- neighbours --------------------------------------------------------------


def brute(rows, k):
    out = {}
    for query, q in rows:
        scored = {}
        for other, x in rows:
            if other != query:
                total = 0.0
                for a, b in zip(q, x, strict=True):
                    total += a * b
                scored[other] = total
        out[query] = sorted(((-s, o) for o, s in scored.items()))[:k]
    return out


def vectors_of(count, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 16)).astype(np.float32) * rng.uniform(0.2, 3, (count, 1)).astype(np.float32)
    x[: count // 3] = x[0]
    return [(n, [float(v) for v in row]) for n, row in enumerate(x)]


def test_small_tables_are_searched_exactly(spark):
    rows = vectors_of(150)
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (None, rows[5][1]), (1004, [1.0]), rows[7]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as ids")
    found = {}
    for r in neighbours.nearest(frame, frame, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(rows, 20)
    assert found == want


def test_recall_on_many_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in enumerate(x)], "vec_id long, embedding array<float>")
    queries = frame.where("vec_id % 200 = 0")
    found = {}
    for r in neighbours.nearest(frame, queries).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for query, got in found.items():
        scores = x.astype(float) @ x[query].astype(float)
        scores[query] = -np.inf
        hits += len(got & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 60 and hits / (60 * 20) >= 0.9


def test_an_id_with_several_vectors(spark):
    """Such an id counts once, with the best score of its vectors, as candidate and as query."""
    rng = np.random.default_rng(8)
    rows = [(n, rng.normal(size=4).tolist()) for n in range(39)]
    rows += [(100, (rng.normal(size=4) + 3 * n).tolist()) for n in range(30)] + [(7, rows[7][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, vectors.where("vec_id IN (3, 100)"), 3).collect()
    for query in (3, 100):
        best = {}
        for vec_id, x in rows:
            for mine, y in rows:
                if mine == query and vec_id != query:
                    score = sum(a * b for a, b in zip(x, y, strict=True))
                    best[vec_id] = max(score, best.get(vec_id, score))
        expected = sorted(best, key=lambda n: (-best[n], n))[:3]
        mine = sorted(r for r in found if r.query_id == query)
        assert [(r["rank"], r.vec_id) for r in mine] == list(enumerate(expected, 1))
        assert [r.score for r in mine] == pytest.approx([best[n] for n in expected])


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few, few).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_visits_grow_slower_than_clustered_vectors():
    """Enough leaves for the recall asked, and a smaller share of the vectors of a larger table."""
    shares = []
    for count in (4_000, 40_000):
        rng = np.random.default_rng(1)
        centres = rng.normal(size=(count // 200, 32))
        x = centres[rng.integers(0, len(centres), count)] + 0.1 * rng.normal(size=(count, 32))
        depth = neighbours.depth_for(count)
        forest = neighbours.fit(x[: neighbours.SAMPLE_OF_LEAF << depth], depth)
        leaves = [neighbours.leaves_of(forest, tree, x) for tree in range(neighbours.TREES)]
        sizes = [np.bincount(found, minlength=1 << depth) for found in leaves]
        assert all(size.sum() == count for size in sizes)
        counts = [dict(enumerate(size.tolist())) for size in sizes]
        products = x[:160] @ x.T
        products[np.arange(160), np.arange(160)] = -np.inf
        near = np.argsort(-products, axis=1)[:, :20]
        points = list(x[:160])
        visits = neighbours.visits_needed(forest, points[:80], [x[rows] for rows in near[:80]])
        hits = scored = 0
        for point, wanted in zip(points[80:], near[80:], strict=True):
            met = np.zeros(count, bool)
            for tree, leaf in neighbours.visited(forest, point, visits, counts, 21):
                met |= leaves[tree] == leaf
                scored += sizes[tree][leaf]
            hits += met[wanted].sum()
        assert hits / (80 * 20) >= 0.9
        shares.append(scored / 80 / count)
    assert shares[1] < 0.2 and shares[1] < shares[0] / 2


def test_visits_follow_the_queue():
    rng = np.random.default_rng(4)
    forest = neighbours.fit(rng.normal(size=(256, 5)), 4)
    point = rng.normal(size=5)
    order = neighbours.visited(forest, point, neighbours.TREES << 4, [{} for _ in range(neighbours.TREES)], 0)
    crossed = neighbours.crossings(forest, point)
    values = [crossed[place] for place in order]
    assert len(set(order)) == neighbours.TREES << 4 and values == sorted(values)
    home = {(tree, int(neighbours.leaves_of(forest, tree, point[None])[0])) for tree in range(neighbours.TREES)}
    assert set(order[: neighbours.TREES]) == home


def test_all_leaves_are_exact(spark, monkeypatch):
    """Several levels and blocks, with ids of equal and of several vectors."""
    monkeypatch.setattr(neighbours, "LEAF_VECTORS", 8)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 7)
    rows = vectors_of(240, seed=9)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 4 = 0")
    found = {}
    every = neighbours.TREES << neighbours.depth_for(240)
    for r in neighbours.nearest(frame, asked, 20, visits=every).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(rows, 20)
    assert found == {query: best for query, best in want.items() if query % 4 == 0}
    few = neighbours.nearest(frame, asked, 20, visits=1).groupBy("query_id").count().collect()
    assert len(few) == 60 and all(r["count"] == 20 for r in few)


# --- models against plain Python ----------------------------------------------


def plain_ftrl(examples, labels):
    """FTRL-proximal, a coordinate at a time."""
    bias = 2**toxicity.BITS
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for columns, y in zip(examples, labels, strict=True):
            at = [*columns, bias]
            w = {i: weight(i) for i in at}
            slope = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                before = n.get(i, 0.0)
                n[i] = before + slope**2
                z[i] = z.get(i, 0.0) + slope - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_a_coordinate_at_a_time():
    rng = random.Random(11)
    examples, labels = [], []
    for _ in range(300):
        y = rng.random() < 0.4
        columns = sorted(rng.sample(range(200), rng.randrange(0, 9)) + ([500] if y and rng.random() < 0.9 else []))
        examples.append(columns)
        labels.append(int(y))
    found = toxicity.fit([np.array(c, np.int32) for c in examples], labels)
    want = plain_ftrl(examples, labels)
    assert set(np.flatnonzero(found).tolist()) == set(want) and 500 in want
    assert [found[i] for i in want] == pytest.approx(list(want.values()))
    assert len(want) < 50  # the L1 term leaves few weights


def test_features_are_words_pairs_and_skips():
    texts = ["One two, three", "two three", "", "ein Über x1y"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    column, text = toxicity.features(np.frombuffer(data, np.uint8), offsets)
    met = [set(column[text == n].tolist()) for n in range(len(texts))]
    # three words, two pairs, one pair with a word between
    assert [len(m) for m in met] == [6, 3, 0, 4 + 3 + 2 + 1]
    assert met[1] < met[0]  # two, three and their pair


def plain_logit(model, text):
    """Mean over the chunks of a text of what its filters' largest responses give."""
    step = quality.CHUNK - quality.OVERLAP
    starts = [0]
    while starts[-1] + quality.CHUNK < len(text):
        starts.append(starts[-1] + step)
    total = 0.0
    for start in starts:
        units = list(text[start : start + quality.CHUNK])
        units += [quality.PADDING] * (quality.CHUNK - len(units))
        value = float(model["bias"][0])
        for f in range(quality.FILTERS):
            best = max(
                sum(
                    float(model["table"][units[at + w], c]) * float(model["filters"][w * quality.TABLE + c, f])
                    for w in range(quality.WIDTH)
                    for c in range(quality.TABLE)
                )
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            )
            value += max(best + float(model["shift"][f]), 0.0) * float(model["out"][f])
        total += value
    return total / len(starts)


def test_quality_logits_equal_plain_python(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 48)
    monkeypatch.setattr(quality, "OVERLAP", 16)
    monkeypatch.setattr(quality, "CHUNKS_AT_ONCE", 3)
    rng = random.Random(3)
    model = quality.fresh_model(9)
    model["shift"] += 0.1
    texts = [bytes(rng.randrange(256) for _ in range(size)) for size in (0, 1, 7, 47, 48, 49, 80, 81, 200)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    found = quality.logits(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert found.tolist() == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-4)
