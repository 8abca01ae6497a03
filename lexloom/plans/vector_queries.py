"""Co-occurrence, vectors, neighbours and language closeness."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import prefix_words
from lexloom.operators import dense, embed, frames, profile, similarity, store
from lexloom.plans import model
from lexloom.plans.model import PROSE_KEYWORDS, quoted, with_frames
from lexloom.plans.registry import query
from lexloom.plans.token_queries import benchmark_tokens
from lexloom.session import drop, durable

MIN_COUNT = 10
WINDOW = 5
ALPHA = 0.1
DENSE = 32
DENSE_ROUNDS = 4
EXTRA_WORDS = ["foreach", "dataclass"]


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Words and pair counts of the prose tokens without rare ones."""
    tokenised = durable(model.prose_tokens(spark, sf), "tokens")
    frequent = durable(profile.frequent_tokens(profile.token_rows(tokenised), MIN_COUNT), "frequent")
    found = frames.numbered_pairs(tokenised, frequent, WINDOW)
    drop(tokenised)
    return found


_PAIR_FRAMES = {
    "kept": "SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok "
    f"WHERE token IN (SELECT token FROM total WHERE freq >= {MIN_COUNT})",
    "pairs": f"""
  SELECT center, context, count(*) AS n FROM (
    SELECT doc_id, token AS center, unnest([lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w,
      lead(token, 4) OVER w, lead(token, 5) OVER w, lag(token, 1) OVER w, lag(token, 2) OVER w, lag(token, 3) OVER w,
      lag(token, 4) OVER w, lag(token, 5) OVER w]) AS context
    FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY p))
  WHERE context IS NOT NULL GROUP BY ALL""",
}


# --- vectors from the embedding table ----------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """`language_keyword` labels for the prose keywords and every keyword of the vectors."""
    prose = spark.createDataFrame([(word,) for word in PROSE_KEYWORDS], "keyword string")
    keywords = prose.unionByName(model.vectors(spark, sf).select("keyword"))
    # At most one row per language.
    languages = sorted(row["language"] for row in model.code(spark, sf).select("language").distinct().collect())
    return similarity.label_grid(keywords, languages, EXTRA_WORDS)


_GRID_SQL = (
    "SELECT language || '_' || keyword AS token FROM (SELECT DISTINCT language FROM code) l, "
    f"(SELECT unnest([{', '.join(quoted(w) for w in PROSE_KEYWORDS)}]) AS keyword UNION SELECT keyword FROM vectors) k "
    f"UNION ALL SELECT unnest([{', '.join(quoted(w) for w in EXTRA_WORDS)}])"
)


@query("j05_token_vectors", with_frames(
    "SELECT token, dim, round(x, 6) AS x FROM (SELECT token, unnest(vec) AS x, CAST(generate_subscripts(vec, 1) - 1 AS INT) AS dim "
    "FROM vectors WHERE token IN (SELECT token FROM grid))",
    "vectors", "code", grid=_GRID_SQL,
))
def j05(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity.word_vectors(_labels(spark, sf), model.vectors(spark, sf).select("token", "vec"))
    return found.select("token", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("j06_label_grid", with_frames("SELECT token FROM grid", "code", "vectors", grid=_GRID_SQL))
def j06(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf)


@query("e05_unit_vectors", with_frames(
    "SELECT token, dim, round(x, 6) AS x FROM (SELECT token, unnest(u) AS x, CAST(generate_subscripts(u, 1) - 1 AS INT) AS dim FROM units)",
    "units",
))
def e05(spark: SparkSession, sf: str) -> DataFrame:
    units = similarity.unit_vectors(model.vectors(spark, sf))
    return units.select("token", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("e06_most_similar", with_frames(
    "SELECT query, token, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, token) AS INT) AS rank "
    "FROM (SELECT q.query, u.token, round(list_dot_product(q.v, u.u) / sqrt(list_dot_product(q.v, q.v)), 6) AS score "
    "FROM analogies q JOIN units u ON u.token <> q.positive AND u.token <> q.negative)) WHERE rank <= 10",
    "units",
    analogies="SELECT p.keyword AS query, p.token AS positive, n.token AS negative, "
    "list_transform(list_zip(p.u, n.u), lambda z: (z[1] - z[2]) / 2) AS v "
    "FROM units p JOIN units n USING (keyword) WHERE p.language = 'C++' AND n.language = 'Python'",
))
def e06(spark: SparkSession, sf: str) -> DataFrame:
    vectors = durable(model.vectors(spark, sf), "vectors")
    sides = vectors.where(F.col("language").isin("C++", "Python"))
    both = sides.groupBy("keyword").agg(F.count("*").alias("n")).where("n = 2").select("keyword")
    terms = sides.join(both, "keyword", "left_semi").select(
        F.col("keyword").alias("query"),
        "token",
        F.when(F.col("language") == "C++", 1.0).otherwise(-1.0).alias("sign"),
    )
    similar = similarity.most_similar(terms, vectors.select("token", "vec"), 10)
    return similar.select("query", "token", "score", "rank")


@query("e07_nearest_neighbour", with_frames(
    "SELECT token, neighbour, score FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, neighbour) AS r "
    "FROM (SELECT a.token, b.token AS neighbour, round(list_dot_product(a.u, b.u), 6) AS score FROM units a JOIN units b ON a.token <> b.token)) WHERE r = 1",
    "units",
))
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.nearest_tokens(model.vectors(spark, sf).select("token", "vec"))


def _word_vectors(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """The most frequent tokens with the embedding vectors, by frequency rank."""
    ranked = store.dense_index(profile.total_frequency(rows), [F.desc("freq"), F.col("token")], "vec_id")
    embeddings = model.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return ranked.join(embeddings, "vec_id").select("token", "vec")


@query("e08_rewrite_documents", with_frames(
    "SELECT doc_id, language, replace(string_agg(coalesce(neighbour, token), ' ' ORDER BY pos), ':', ':' || chr(10)) AS document "
    "FROM tok LEFT JOIN near USING (token) GROUP BY doc_id, language",
    "total", "tok",
    ranked="SELECT token, row_number() OVER (ORDER BY freq DESC, token) - 1 AS vec_id FROM total",
    worded="SELECT token, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM "
    "(SELECT token, CAST(embedding AS DOUBLE[]) AS v FROM ranked JOIN embeddings USING (vec_id))",
    near="SELECT token, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, neighbour) AS r "
    "FROM (SELECT a.token, b.token AS neighbour, round(list_dot_product(a.u, b.u), 6) AS score FROM worded a JOIN worded b ON a.token <> b.token)) WHERE r = 1",
))
def e08(spark: SparkSession, sf: str) -> DataFrame:
    tokenised = durable(model.prose_tokens(spark, sf), "tokens")
    vectors = _word_vectors(spark, sf, profile.token_rows(tokenised))
    neighbours = durable(similarity.nearest_tokens(vectors), "neighbours")
    return similarity.rewritten(tokenised, neighbours)


@query("e13_language_closeness", with_frames(
    "SELECT a.language AS first, b.language AS second, round(avg(list_dot_product(a.u, b.u)), 4) AS closeness, count(*) AS keywords "
    "FROM units a JOIN units b USING (keyword) WHERE a.language < b.language GROUP BY ALL",
    "units",
))
def e13(spark: SparkSession, sf: str) -> DataFrame:
    labelled = model.vectors(spark, sf).where(F.col("language").isNotNull())
    return similarity.language_closeness(labelled).withColumn("closeness", F.round("closeness", 4))


def _axis_frames(number: int, squarings: int = 18) -> dict[str, str]:
    """Frames for the leading axis of `matrix{number}` (i, j, v): its powers, by squaring, tend to the axis times itself."""
    power = f"power{number}_"
    found = {f"{power}0": f"SELECT i, j, v / (SELECT sum(v) FROM matrix{number} WHERE i = j) AS v FROM matrix{number}"}
    for step in range(1, squarings + 1):
        found[f"square{number}_{step}"] = (
            f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {power}{step - 1} a JOIN {power}{step - 1} b ON a.j = b.i GROUP BY ALL"
        )
        found[f"{power}{step}"] = (
            f"SELECT i, j, v / (SELECT sum(v) FROM square{number}_{step} WHERE i = j) AS v FROM square{number}_{step}"
        )
    # The column of the largest loading, which is positive.
    last = f"{power}{squarings}"
    found[f"axis{number}"] = (
        f"SELECT p.i, p.v / sqrt(c.v) AS v FROM {last} p JOIN (SELECT i, v FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1) c ON p.j = c.i"
    )
    found[f"size{number}"] = (
        f"SELECT sum(a.v * m.v * b.v) AS v FROM matrix{number} m JOIN axis{number} a ON m.i = a.i JOIN axis{number} b ON m.j = b.i"
    )
    found[f"matrix{number + 1}"] = (
        f"SELECT m.i, m.j, m.v - s.v * a.v * b.v AS v FROM matrix{number} m JOIN axis{number} a ON m.i = a.i "
        f"JOIN axis{number} b ON m.j = b.i, size{number} s"
    )
    return found


_PLANE_FRAMES = {
    "entries": "SELECT token, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM units",
    "centred": "SELECT token, i, x - avg(x) OVER (PARTITION BY i) AS x FROM entries",
    "matrix1": "SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM centred a JOIN centred b USING (token) GROUP BY ALL",
    **_axis_frames(1),
    **_axis_frames(2),
    "plane": "SELECT token, sum(x * a.v) AS x, sum(x * b.v) AS y FROM centred JOIN axis1 a USING (i) JOIN axis2 b USING (i) GROUP BY token",
}


def _stepwise(sql: str) -> str:
    """Frames written down, as each is used more than once."""
    return re.sub(r"^(\w+) AS \(|^WITH (\w+) AS \(", _materialized, sql, flags=re.MULTILINE)


def _materialized(found: re.Match) -> str:
    return f"WITH {found[2]} AS MATERIALIZED (" if found[2] else f"{found[1]} AS MATERIALIZED ("


@query("e11_plane", _stepwise(with_frames("SELECT token, round(x, 4) AS x, round(y, 4) AS y FROM plane", "units", **_PLANE_FRAMES)))
def e11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = similarity.unit_vectors(model.vectors(spark, sf).select("token", "vec"))
    return similarity.plane(vectors).select("token", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("e12_word_map", _stepwise(with_frames(
    "SELECT token, CASE WHEN len(p) = 2 THEN p[1] ELSE '' END AS language, CASE WHEN len(p) = 2 THEN p[2] ELSE token END AS keyword, round(x, 4) AS x, round(y, 4) AS y, "
    "round(x + 0.005 * (SELECT max(x) - min(x) FROM plane), 4) AS label_x FROM (SELECT *, string_split(token, '_') AS p FROM plane)",
    "units", **_PLANE_FRAMES,
)))
def e12(spark: SparkSession, sf: str) -> DataFrame:
    vectors = durable(model.vectors(spark, sf).select("token", "vec"), "vectors")
    words = similarity.word_map(vectors.select("token").distinct(), vectors)
    return words.withColumns({name: F.round(name, 4) for name in ("x", "y", "label_x")})


@query("a13_coordinate_ranges", with_frames(
    "SELECT round(max(x) - min(x), 4) AS range_x, round(max(y) - min(y), 4) AS range_y FROM (SELECT u[1] AS x, u[2] AS y FROM units)",
    "units",
))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec")
    points = similarity.unit_vectors(model.vectors(spark, sf)).select(
        F.get(vec, F.lit(0)).alias("x"), F.get(vec, F.lit(1)).alias("y")
    )
    ranges = similarity.coordinate_ranges(points)
    return ranges.select(F.round("range_x", 4).alias("range_x"), F.round("range_y", 4).alias("range_y"))


# --- co-occurrence -----------------------------------------------------------


@query("e03_pair_counts", with_frames("SELECT * FROM pairs", "tok", "total", **_PAIR_FRAMES))
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return frames.named_pairs(*_pairs(spark, sf))


@query("e04_positive_pmi", with_frames(
    "SELECT center, context, round(greatest(ln(n * w / (CAST(a.t AS DOUBLE) * b.t)), 0), 4) AS ppmi "
    "FROM pairs JOIN sums a USING (center) JOIN sums b ON b.center = context, (SELECT CAST(sum(t) AS DOUBLE) AS w FROM sums)",
    "tok", "total", **_PAIR_FRAMES,
    sums="SELECT center, sum(n) AS t FROM pairs GROUP BY center",
))
def e04(spark: SparkSession, sf: str) -> DataFrame:
    index, pairs = _pairs(spark, sf)
    ppmi = frames.positive_pmi(pairs).withColumn("ppmi", F.round("ppmi", 4))
    return frames.named_pairs(index, ppmi)


@query("e04_dense_vectors")
def e04_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of DENSE numbers per word, whose products approximate the PPMI table."""
    index, pairs = _pairs(spark, sf)
    weights = frames.positive_pmi(pairs).withColumnRenamed("ppmi", "weight")
    found = dense.dense_vectors(weights, DENSE, rounds=DENSE_ROUNDS, words=index.count())
    drop(pairs)
    return index.join(found.vectors, "word").select("token", "vec")


def _scores(spark: SparkSession, sf: str) -> frames.Scores:
    return frames.score_tables(*_pairs(spark, sf), ALPHA)


@query("e09_predict_center", with_frames(
    "SELECT key, center, rank FROM (SELECT key, center, CAST(row_number() OVER (PARTITION BY key ORDER BY "
    "round(base + gain, 6) DESC, center) AS INT) AS rank FROM "
    f"(SELECT key, center, sum(ln((n + {ALPHA}) / {ALPHA})) AS gain FROM words JOIN pairs ON context = token GROUP BY ALL) "
    f"JOIN (SELECT key, sum(ln({ALPHA} / (t + {ALPHA} * v))) AS base FROM words JOIN sums ON context = token, (SELECT count(*) AS v FROM sums) GROUP BY key) USING (key)) "
    "WHERE rank <= 10",
    "tok", "total", **_PAIR_FRAMES,
    sums="SELECT context, sum(n) AS t FROM pairs GROUP BY context",
    words=f"SELECT item_id AS key, unnest(t[-5:]) AS token FROM (SELECT item_id, {model.sql_generic('text')} AS t FROM benchmark)",
))
def e09(spark: SparkSession, sf: str) -> DataFrame:
    last = F.slice("tokens", F.greatest(F.size("tokens") - frames.RECENT, F.lit(0)) + 1, F.lit(frames.RECENT))
    contexts = benchmark_tokens(spark, sf).select(F.col("doc_id").alias("key"), last.alias("context"))
    return frames.predict_center(contexts, _scores(spark, sf)).select("key", "center", "rank")


def _step_sql(number: int) -> dict[str, str]:
    """Frames that extend the prompts of `state{number}` by one step."""
    repeatable = ", ".join(quoted(word) for word in frames.REPEATABLE)
    recent, many = frames.RECENT, frames.CANDIDATES
    return {
        f"terms{number}": f"SELECT key, token FROM (SELECT key, unnest(tokens[-{recent}:]) AS token FROM state{number}) "
        "WHERE token IN (SELECT context FROM sums)",
        f"best{number}": "SELECT key, center, row_number() OVER (PARTITION BY key ORDER BY round(base + gain, 6) DESC, center) AS rank "
        f"FROM (SELECT key, center, sum(ln((n + {ALPHA}) / {ALPHA})) AS gain FROM terms{number} JOIN pairs ON context = token GROUP BY ALL) "
        f"JOIN (SELECT key, sum(ln({ALPHA} / (t + {ALPHA} * v))) AS base FROM terms{number} JOIN sums ON context = token, "
        "(SELECT count(*) AS v FROM sums) GROUP BY key) USING (key)",
        f"grown{number}": "SELECT key, tokens, words, CASE WHEN words IS NULL THEN tokens ELSE "
        "list_reduce(list_transform(words, lambda w: [w]), lambda grown, word: "
        f"CASE WHEN list_contains(grown[-{recent}:], word[1]) AND word[1] NOT IN ({repeatable}) THEN grown ELSE list_concat(grown, word) END, tokens) "
        f"END AS grown FROM state{number} LEFT JOIN (SELECT key, list(center ORDER BY rank) AS words FROM best{number} "
        f"WHERE rank <= {many} GROUP BY key) USING (key)",
        f"state{number + 1}": "SELECT key, CASE WHEN len(grown) = len(tokens) AND words IS NOT NULL THEN list_concat(tokens, words[1:1]) "
        f"ELSE grown END AS tokens FROM grown{number}",
    }


def _continued_sql() -> str:
    steps = {"state0": f"SELECT item_id AS key, {model.sql_generic('text')} AS tokens FROM benchmark"}
    for number in range(frames.STEPS):
        steps |= _step_sql(number)
    sums = {"sums": "SELECT context, sum(n) AS t FROM pairs GROUP BY context"}
    body = f"SELECT key, array_to_string(tokens, ' ') AS text FROM state{frames.STEPS}"
    sql = with_frames(body, "tok", "total", **_PAIR_FRAMES, **sums, **steps)
    return _stepwise(sql)


@query("e10_continue_prompts", _continued_sql())
def e10(spark: SparkSession, sf: str) -> DataFrame:
    prompts = benchmark_tokens(spark, sf).select(F.col("doc_id").alias("key"), "tokens")
    continued = frames.continue_prompts(prompts, _scores(spark, sf))
    return continued.select("key", F.array_join("tokens", " ").alias("text"))


# --- trained vectors ---------------------------------------------------------


def _prefixed(spark: SparkSession, sf: str) -> DataFrame:
    tokens = prefix_words(F.col("tokens"), F.col("language"), PROSE_KEYWORDS)
    return durable(model.prose_tokens(spark, sf).withColumn("tokens", tokens), "prefixed")


def _norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("token", F.size("vec").alias("dimensions"))


@query("e01_train_vectors", with_frames(
    f"SELECT token, CAST(200 AS INT) AS dimensions FROM (SELECT CASE WHEN token IN ({', '.join(quoted(w) for w in PROSE_KEYWORDS)}) "
    f"THEN language || '_' || token ELSE token END AS token FROM tok) GROUP BY token HAVING count(*) >= {MIN_COUNT}",
    "tok",
))
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return _norms(embed.vectors_of(embed.train_vectors(_prefixed(spark, sf), size=200, min_count=MIN_COUNT)))


@query("e02_train_language_vectors", with_frames(
    "SELECT token, CAST(32 AS INT) AS dimensions FROM tok WHERE language = 'Python' GROUP BY token HAVING count(*) >= 5",
    "tok",
))
def e02(spark: SparkSession, sf: str) -> DataFrame:
    tokenised = durable(model.prose_tokens(spark, sf), "tokens")
    trained = embed.train_language_vectors(tokenised, "Python", size=32, window=10, min_count=5)
    return _norms(embed.vectors_of(trained))
