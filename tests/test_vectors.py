"""Windows, counts, neighbours and training against plain Python."""

import glob
import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import embed, frames, grid, pivots, profile, similarity
from lexloom.session import drop, durable

RNG = random.Random(7)
WORDS = [f"w{n}" for n in range(12)]
DOCS = [[RNG.choice(WORDS) for _ in range(RNG.randrange(0, 30))] for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, "Go" if n % 2 else "C", tokens) for n, tokens in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")


def counted(docs=DOCS, window=5):
    pairs = Counter()
    for tokens in docs:
        for i, center in enumerate(tokens):
            for j in range(max(0, i - window), min(len(tokens), i + window + 1)):
                if i != j:
                    pairs[center, tokens[j]] += 1
    return pairs


def test_frames(docs):
    for row in frames.context_frames(docs, 3).collect():
        tokens = DOCS[row.doc_id]
        assert row.context == tokens[max(0, row.pos - 3) : row.pos] + tokens[row.pos + 1 : row.pos + 4]
    recent = frames.recent_frames(docs).collect()
    assert len(recent) == sum(map(len, DOCS))
    for row in recent:
        assert row.recent == DOCS[row.doc_id][: row.pos][-5:]


def test_frames_are_not_interpreted(docs):
    """No function runs over the tokens of a list: rows are made and sliced in generated code."""
    for framed in (frames.context_frames(docs, 3), frames.recent_frames(docs)):
        assert "lambda" not in framed._jdf.queryExecution().toString()


def test_frames_of_odd_lists(spark):
    rows = [(1, "Go", ["a", None, "b"]), (1, "Go", ["a", None, "b"]), (2, None, []), (None, "C", None), (None, "C", ["z"])]
    odd = spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")
    found = sorted(map(tuple, frames.context_frames(odd, 1).collect()), key=str)
    twice = [(1, "Go", 0, "a", [None]), (1, "Go", 2, "b", [None])] * 2
    assert found == sorted([*twice, (None, "C", 0, "z", [])], key=str)


@pytest.mark.parametrize("window", [1, 5, 10])
def test_pair_counts(docs, window):
    found = {(r.center, r.context): r.n for r in frames.pair_counts(docs, window).collect()}
    assert found == counted(window=window)


def test_pruning_comes_before_windows(docs, spark):
    kept = spark.createDataFrame([(w,) for w in WORDS[:5]], "token string")
    pruned = [[t for t in tokens if t in WORDS[:5]] for tokens in DOCS]
    found = {(r.center, r.context): r.n for r in frames.pair_counts(frames.pruned(docs, kept)).collect()}
    assert found == counted(pruned)
    found = {(r.center, r.context): r.n for r in frames.corpus_pairs(docs, kept).collect()}
    assert found == counted(pruned)


def test_positive_pmi(docs):
    pairs = counted()
    sums = Counter()
    for (center, _), n in pairs.items():
        sums[center] += n
    whole = sum(sums.values())
    for row in frames.positive_pmi(frames.pair_counts(docs)).collect():
        n = pairs[row.center, row.context]
        expected = max(0.0, math.log(n * whole / (sums[row.center] * sums[row.context])))
        assert row.ppmi == pytest.approx(expected, abs=1e-9)


def predicted(pairs, context, alpha=0.1, topn=10):
    sums = Counter()
    for (_, word), n in pairs.items():
        sums[word] += n
    known = [w for w in context if w in sums]
    base = sum(math.log(alpha / (sums[w] + alpha * len(sums))) for w in known)
    scores = defaultdict(float)
    for (center, word), n in pairs.items():
        if word in known:
            scores[center] += known.count(word) * math.log((n + alpha) / alpha)
    ranked = sorted(scores, key=lambda w: (-round(base + scores[w], 6), w))
    return ranked[:topn]


PROMPTS = [["w1", "w2"], ["w3"], ["unknown"], ["w0", "w4", "w5", "w6", "w7", "w8", "w9"], ["w2", "w2", "w3"]]


def test_predict_and_continue(docs, spark):
    pairs = counted()
    every_word = profile.vocabulary(profile.token_rows(docs))
    scores = frames.score_tables(*frames.numbered_pairs(docs, every_word))
    rows = list(enumerate(PROMPTS))
    contexts = spark.createDataFrame([(k, p[-5:]) for k, p in rows], "key long, context array<string>")
    found = defaultdict(list)
    for row in frames.predict_center(contexts, scores).orderBy("key", "rank").collect():
        found[row.key].append(row.center)
    for key, prompt in rows:
        assert found[key] == predicted(pairs, prompt[-5:])

    prompts = spark.createDataFrame(rows, "key long, tokens array<string>")
    continued = dict(frames.continue_prompts(prompts, scores, steps=4).collect())
    for key, prompt in rows:
        recent = list(prompt)
        for _ in range(4):
            candidates = predicted(pairs, recent[-5:])
            grown = False
            for token in candidates:
                if token in recent[-5:] and token not in ("import", ","):
                    continue
                recent.append(token)
                grown = True
            if not grown and candidates:
                recent.append(candidates[0])
        assert continued[key] == recent


@pytest.mark.parametrize("limit", [0, 8 * 1024 * 1024])
def test_wanted_gains_by_broadcast_and_by_shuffle(docs, spark, monkeypatch, limit):
    """Gains are picked alike whether or not the wanted pairs fit a broadcast."""
    monkeypatch.setattr(frames, "SOUGHT_BYTES", limit)
    sent, send = [], frames.broadcast_if_small
    monkeypatch.setattr(frames, "broadcast_if_small", lambda df, *most: sent.append((df.columns, *most)) or send(df, *most))
    scores = frames.score_tables(*frames.numbered_pairs(docs, profile.vocabulary(profile.token_rows(docs))))
    contexts = spark.createDataFrame([(0, ["w1", "w2"]), (1, ["w2", "w2", "w3"])], "key long, context array<string>")
    found = defaultdict(list)
    for row in frames.predict_center(contexts, scores).orderBy("key", "rank").collect():
        found[row.key].append(row.center)
    assert found == {key: predicted(counted(), words) for key, words in enumerate([["w1", "w2"], ["w2", "w2", "w3"]])}
    assert (["context", "center"], limit) in sent


def test_a_hot_word_is_not_read_whole(spark, monkeypatch):
    """A context word with 600 centers in 150 blocks: the first blocks settle the best ones."""
    rows = [(0, c, 1 + (5000 // c)) for c in range(1, 600)] + [(1, c, 2000 - 100 * c) for c in range(2, 16)]
    rows = [(a, b, n) for a, b, n in rows] + [(b, a, n) for a, b, n in rows]
    pairs = spark.createDataFrame(rows, "center int, context int, n long")
    index = spark.createDataFrame([(n, f"w{n:03d}") for n in range(600)], "word int, token string")
    scores = frames.score_tables(index, pairs, block=4)
    asked = frames.durable(spark.createDataFrame([([0, 1],), ([0],), ([0, 0, 1],)], "words array<int>"))
    rounds = []
    plain = frames.durable
    monkeypatch.setattr(frames, "durable", lambda df, name="": rounds.append(name) or plain(df, name))
    found = defaultdict(list)
    for row in frames.best_centers(asked, scores).orderBy("rank").collect():
        found[tuple(row.words)].append(row.center)
    assert rounds.count("met") <= 3 < math.log2(150)
    gains = {(a, b): math.log((n + 0.1) / 0.1) for b, a, n in rows}
    for words, centers in found.items():
        totals = defaultdict(float)
        for word in words:
            for (context, center), gain in gains.items():
                if context == word:
                    totals[center] += gain
        assert centers == sorted(totals, key=lambda c: (-round(totals[c], 6), c))[:10]


def test_numbers_beyond_a_broadcast_are_joined(docs, spark, monkeypatch):
    words = profile.vocabulary(profile.token_rows(docs))
    for limit in (frames.BROADCAST_BYTES, 0):
        monkeypatch.setattr(frames, "BROADCAST_BYTES", limit)
        found = {(r.center, r.context): r.n for r in frames.corpus_pairs(docs, words, 3).collect()}
        assert found == counted(window=3)


def test_folding_of_pairs_in_small_chunks(monkeypatch):
    lists = pa.array([[1, 2, 2], None, [], [3], [1, 2, 3, 1]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists], names=["tokens"])
    monkeypatch.setattr(frames, "CHUNK_TOKENS", 2)
    found = Counter()
    for part in frames._counted_windows(2)(iter([batch, batch.slice(4)])):
        for row in part.to_pylist():
            found[row["low"], row["high"]] += row["n"]
    assert found == {(1, 2): 6, (2, 2): 1, (2, 3): 2, (1, 3): 4}


def test_counts_travel_as_few_rows(docs, monkeypatch):
    """A chunk sends a row for each slice and not one for each pair, and slices sum to all pairs both ways."""
    monkeypatch.setattr(frames, "PAIR_SLICES", 4)
    lists = pa.array([[WORDS.index(t) for t in tokens] for tokens in DOCS] + [None, []], pa.list_(pa.int32()))
    for size in (7, 500_000):
        monkeypatch.setattr(frames, "CHUNK_TOKENS", size)
        batch = pa.RecordBatch.from_arrays([lists], names=["tokens"])
        sent = pa.Table.from_batches(frames._sliced(5)(iter([batch, batch.slice(0, 0)])))
        assert size == 7 or len(sent) == 4 < len(counted())
        dealt = sent.sort_by("slice").combine_chunks()
        pieces = [part for n in range(0, len(dealt), 3) for part in dealt.slice(n, 3).to_batches()]
        rows = [row for part in frames._summed_slices(iter(pieces)) for row in part.to_pylist()]
        found = {(WORDS[row["center"]], WORDS[row["context"]]): row["n"] for row in rows}
        assert len(found) == len(rows) and found == counted()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{n:03d}", rng.normal(size=8).tolist()) for n in range(120)]
    rows += [("twin_a", rows[0][1]), ("twin_b", rows[0][1]), ("zero", [0.0] * 8)]
    return spark.createDataFrame(rows, "token string, vec array<double>")


def as_units(vectors):
    rows = {r.token: np.array(r.vec) for r in vectors.collect()}
    return {t: v / (np.linalg.norm(v) or 1.0) for t, v in rows.items()}


def ranked(units, query, excluded, topn):
    scores = {t: round(float(query @ v), 6) for t, v in units.items() if t not in excluded}
    return sorted(scores, key=lambda t: (-scores[t], t))[:topn]


def test_unit_vectors(vectors):
    for row in similarity.unit_vectors(vectors).collect():
        length = np.linalg.norm(row.vec)
        assert length == pytest.approx(0.0 if row.token == "zero" else 1.0, abs=1e-9)


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest_in_one_or_many_blocks(vectors, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    units = as_units(vectors)
    found = {r.token: r.neighbour for r in similarity.nearest_tokens(vectors).collect()}
    assert set(found) == set(units)
    for token, neighbour in found.items():
        assert [neighbour] == ranked(units, units[token], {token}, 1)


@pytest.mark.parametrize("block", [2048, 16])
def test_most_similar(vectors, spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    units = as_units(vectors)
    terms = [("q1", "t001", 1.0), ("q1", "t002", -1.0), ("q2", "t003", 1.0), ("q2", "t004", 1.0), ("q2", "none", 1.0)]
    frame = spark.createDataFrame(terms, "query string, token string, sign double")
    found = defaultdict(list)
    for row in similarity.most_similar(frame, vectors, 7).orderBy("query", "rank").collect():
        found[row.query].append(row.token)
    q1, q2 = units["t001"] - units["t002"], units["t003"] + units["t004"]
    assert found["q1"] == ranked(units, q1 / np.linalg.norm(q1), {"t001", "t002"}, 7)
    assert found["q2"] == ranked(units, q2 / np.linalg.norm(q2), {"t003", "t004"}, 7)


def test_plane_equals_svd(vectors):
    rows = {r.token: np.array(r.vec) for r in vectors.collect()}
    names = sorted(rows)
    matrix = np.stack([rows[n] for n in names])
    centred = matrix - matrix.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes = np.stack([a * np.sign(a[np.argmax(np.abs(a))]) for a in axes])
    expected = centred @ axes.T
    found = {r.token: (r.x, r.y) for r in similarity.plane(vectors).collect()}
    np.testing.assert_allclose([found[n] for n in names], expected, atol=1e-8)


def test_word_map(spark, vectors):
    words = spark.createDataFrame([("t001",), ("t002",), ("t003",), ("twin_a",), ("absent",)], "token string")
    rows = {r.token: r for r in similarity.word_map(words, vectors).collect()}
    assert set(rows) == {"t001", "t002", "t003", "twin_a"}
    assert (rows["twin_a"].language, rows["twin_a"].keyword) == ("twin", "a")
    assert (rows["t001"].language, rows["t001"].keyword) == ("", "t001")
    spread = max(r.x for r in rows.values()) - min(r.x for r in rows.values())
    for row in rows.values():
        assert row.label_x == pytest.approx(row.x + 0.005 * spread)


def test_training(docs):
    def train():
        return embed.train_vectors(docs, size=6, window=5, min_count=8, epochs=2, partitions=1)

    first, again = (dict(embed.vectors_of(train()).collect()) for _ in range(2))
    frequent = {r.token for r in profile.frequent_tokens(profile.token_rows(docs), 8).collect()}
    assert set(first) == frequent
    assert all(len(v) == 6 for v in first.values())
    assert first == again
    one = embed.vectors_of(embed.train_language_vectors(docs, "Go", size=4, min_count=1))
    assert {r.token for r in one.collect()} == {t for n, d in enumerate(DOCS) if n % 2 for t in d}


def topics(spark, files=200):
    """Files of one topic each: words of a topic, and words of all topics."""
    rng = np.random.default_rng(1)
    rows = []
    for n in range(files):
        drawn = zip(rng.integers(0, 20, 60).tolist(), rng.random(60).tolist())
        rows.append((n, "Go", [f"t{n % 4}_{k}" if u < 0.8 else f"all_{k}" for k, u in drawn]))
    return spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")


def test_training_learns_topics_in_blocks(spark):
    """Vectors dealt over blocks: words of a topic are nearest to each other, and reruns agree."""
    files = topics(spark)
    first, again = (dict(embed.vectors_of(embed.train_vectors(files.repartition(n), size=16, partitions=6)).collect()) for n in (3, 3))
    assert first == again
    names = sorted(word for word in first if word.startswith("t"))
    units = np.array([first[word] for word in names])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = units @ units.T - 9 * np.eye(len(names))
    assert all(names[a][:2] == names[b][:2] for a, b in enumerate(scores.argmax(axis=1)))


def test_training_leaves_the_model_off_the_driver(spark, monkeypatch):
    """Parts are small: more parts than tasks ask for are made, and the driver fits no MLlib model."""
    monkeypatch.setattr(grid, "PART_BYTES", 1000)
    met, meet = [], grid.meet
    monkeypatch.setattr(grid, "meet", lambda rows, side, *rest: met.append(side) or meet(rows, side, *rest))
    trained = embed.train_vectors(topics(spark, 40), size=6, min_count=2, epochs=1, partitions=1)
    assert not hasattr(trained, "getVectors") and met[0] >= 100 * 8 * 4 // 1000
    assert {len(vec) for _, vec in embed.vectors_of(trained).collect()} == {6}


def test_training_makes_each_part_once(spark, monkeypatch):
    """A pass over the pairs makes every vector once: no copies of parts, whose bytes would grow with the square of the words."""
    made, meet = [], grid.meet

    def counted(rows, side, run, schema):
        found = meet(rows, side, run, schema)
        made.append((schema, found.select(F.sum(F.length("data"))).first()[0]))
        return found

    monkeypatch.setattr(grid, "meet", counted)
    trained = embed.train_vectors(topics(spark, 40), size=6, min_count=2, epochs=2, partitions=4)
    words = embed.vectors_of(trained).count()
    assert len(made) == 4 and {size for _, size in made} == {words * 8 * 4}


def test_gradient_of_runs():
    """Runs of pairs of any length, met side by side or one by one, give the gradient of single pairs."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 3, 7, 64, 65, 200, 1, 5])
    vectors, fixed = rng.normal(size=(len(sizes), 6)).astype(np.float32), rng.normal(size=(40, 6)).astype(np.float32)
    theirs, weight = rng.integers(0, 40, sizes.sum()), rng.integers(1, 9, sizes.sum()).astype(np.float32)
    want = np.zeros((len(sizes), 6))
    for n, other, times in zip(np.repeat(np.arange(len(sizes)), sizes), theirs, weight):
        want[n] += times * fixed[other] / (1 + math.exp(fixed[other] @ vectors[n]))
    got = embed._pulls(vectors, np.cumsum(sizes) - sizes, sizes, fixed, theirs, weight)
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-4)


def test_results_kept_leave_no_shuffle_files(spark):
    """Shuffle files go with the step that made them, and tables that are used up can be dropped."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for top in disk.localDirsString() for f in glob.glob(f"{top}/*/shuffle_*")}
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    earlier = held()
    stored = durable(spark.range(1000).repartition(4, "id"), "shuffled")
    assert len(stored.collect()) == 1000
    until = time.time() + 10
    while held() - earlier and time.time() < until:
        time.sleep(0.2)
    assert not [f for f in held() - earlier if f.endswith(".data")]
    files = [f.removeprefix("file://") for f in stored.inputFiles()]
    assert all(map(os.path.exists, files))
    drop(stored)
    assert not any(map(os.path.exists, files))


def test_lists_are_cut(spark, monkeypatch):
    """Lists are cut after rare words have left."""
    seen, counted = [], frames.near_pairs
    monkeypatch.setattr(frames, "near_pairs", lambda lists, window: seen.extend(lists.collect()) or counted(lists, window))
    rows = [(n, "Go", ["a", "b", "rare" + str(n), "c", "d"]) for n in range(3)]
    files = spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")
    trained = embed.train_vectors(files, size=4, window=2, min_count=3, epochs=0, max_sentence=2)
    assert {token for token, _ in embed.vectors_of(trained).collect()} == set("abcd")
    assert sorted(row.tokens for row in seen) == [[0, 1]] * 3 + [[2, 3]] * 3


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_training_with_null_tokens(spark, monkeypatch, limit):
    """A frequent null is a token, whether tokens are numbered by a join or by a broadcast."""
    monkeypatch.setattr(frames, "BROADCAST_BYTES", limit)
    seen, counted = [], frames.near_pairs
    monkeypatch.setattr(frames, "near_pairs", lambda lists, window: seen.extend(lists.collect()) or counted(lists, window))
    rows = [(n, None, ["a", None, "rare" + str(n), "b"]) for n in range(3)] + [(4, "Go", None)]
    files = spark.createDataFrame(rows, "doc_id long, language string, tokens array<string>")
    trained = embed.train_vectors(files, size=4, min_count=3, epochs=1)
    assert {token for token, _ in embed.vectors_of(trained).collect()} == {"a", None, "b"}
    assert sorted(row.tokens for row in seen if row.tokens) == [[1, 0, 2]] * 3


def test_training_of_nothing(spark):
    files = spark.createDataFrame([(1, "Go", None), (2, "Go", [])], "doc_id long, language string, tokens array<string>")
    assert embed.vectors_of(embed.train_vectors(files, size=4, epochs=1)).count() == 0


@pytest.mark.parametrize("big", [0, 1 << 30])
def test_near_pairs(spark, big):
    """A pair weighs what windows of each size up to the largest count of it."""
    rng = np.random.default_rng(3)
    lists = [(rng.integers(0, 6, n) + big).tolist() for n in (0, 1, 30, 40)]
    want = {}
    for words in lists:
        for width in range(1, 4):
            for i, center in enumerate(words):
                for context in words[max(i - width, 0) : i] + words[i + 1 : i + 1 + width]:
                    want[center, context] = want.get((center, context), 0) + 1
    frame = spark.createDataFrame([(words,) for words in lists], "tokens array<int>")
    assert {(r.center, r.context): r.n for r in frames.near_pairs(frame, 3).collect()} == want


def test_vocabulary_sizes(spark):
    rows = [("Go", f"t{n}", n) for n in (1, 9, 10, 11, 25, 130, 1000, 5000)]
    frequency = spark.createDataFrame(rows, "language string, token string, freq long")
    found = {r.min_freq: r.vocabulary for r in profile.vocabulary_sizes(frequency).collect()}
    assert found[10] == 6 and found[20] == 4 and found[120] == 3 and found[140] == 2 and found[1000] == 2


def test_split_and_sample_ignore_partitioning(docs):
    for run in (profile.train_test, lambda df: profile.sample_files(df, 5)):
        assert sorted(run(docs.repartition(7)).collect()) == sorted(run(docs.coalesce(1)).collect())
    parts = profile.train_test(docs.sparkSession.range(5000).withColumnRenamed("id", "doc_id"))
    assert 0.17 < parts.where(F.col("part") == "test").count() / 5000 < 0.23
