"""Token vectors: lookup, analogies, nearest neighbours, closeness, maps."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import joined_document, label_keyword, label_language
from lexloom.functions.vectors import dot, unit
from lexloom.operators.pivots import nearest
from lexloom.operators.profile import token_rows
from lexloom.session import broadcast_if_small, durable


def known_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return words.join(vocabulary.select("token"), "token", "left_semi")


def word_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    return words.join(vectors, "token")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit(F.col("vec")))


def label_grid(keywords: DataFrame, languages: list[str], extra: list[str]) -> DataFrame:
    """`language_keyword` for every language and distinct keyword, plus extra words."""
    names = F.array(*[F.lit(name) for name in languages]).cast("array<string>")
    pairs = keywords.select("keyword").distinct().select(F.explode(names).alias("language"), "keyword")
    grid = pairs.select(F.concat_ws("_", "language", "keyword").alias("token"))
    more = F.array(*[F.lit(word) for word in extra]).cast("array<string>")
    return grid.unionByName(keywords.sparkSession.range(1).select(F.explode(more).alias("token")))


# --- nearest neighbours ------------------------------------------------------


def nearest_tokens(vectors: DataFrame) -> DataFrame:
    """The nearest other token of every token: (token, neighbour, score)."""
    units = durable(unit_vectors(vectors), "units")
    queries = units.select(
        F.col("token").alias("query"), "vec", F.array("token").alias("excluded")
    )
    return nearest(queries, units, 1).select(
        F.col("query").alias("token"), F.col("token").alias("neighbour"), "score"
    )


def most_similar(terms: DataFrame, vectors: DataFrame, topn: int = 10) -> DataFrame:
    """Analogies: mean of unit positives minus unit negatives, inputs excluded.

    `terms` has (query, token, sign) with sign +1 or -1; unknown tokens are
    dropped from their query.
    """
    units = durable(unit_vectors(vectors), "units")
    signed = terms.join(units, "token").select(
        "query", "token", F.posexplode(F.transform("vec", lambda x: x * F.col("sign"))).alias("dim", "x")
    )
    sums = signed.groupBy("query", "dim").agg(F.sum("x").alias("x"))
    means = sums.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("sums")
    )
    inputs = terms.groupBy("query").agg(F.collect_set("token").alias("excluded"))
    queries = means.join(inputs, "query").select(
        "query", unit(F.transform("sums", lambda s: s["x"])).alias("vec"), "excluded"
    )
    return nearest(queries, units, topn)


# --- documents rewritten -----------------------------------------------------


def rewritten(tokenised: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Each token replaced by its nearest neighbour (a stored table); unknown
    tokens stay."""
    near = broadcast_if_small(neighbours.select("token", "neighbour"))
    rows = token_rows(tokenised.repartition("doc_id")).join(near, "token", "left")
    swapped = F.coalesce("neighbour", "token").alias("token")
    ordered = F.array_sort(F.collect_list(F.struct("pos", swapped)))
    return rows.groupBy("doc_id", "language").agg(
        joined_document(F.transform(ordered, lambda s: s["token"])).alias("document")
    )


# --- language closeness ------------------------------------------------------


def language_closeness(labelled: DataFrame) -> DataFrame:
    """Mean cosine over shared keywords for each pair of languages.

    `labelled` has one (language, keyword, vec) row per language and keyword,
    so a keyword meets itself at most once per pair of languages.
    """
    units = labelled.withColumn("vec", unit(F.col("vec")))
    left = units.select(F.col("language").alias("first"), "keyword", F.col("vec").alias("a"))
    right = units.select(F.col("language").alias("second"), "keyword", F.col("vec").alias("b"))
    return (
        left.join(right, "keyword")
        .where(F.col("first") < F.col("second"))
        .groupBy("first", "second")
        .agg(F.avg(dot(F.col("a"), F.col("b"))).alias("closeness"), F.count("*").alias("keywords"))
    )


# --- two-dimensional maps ----------------------------------------------------


def plane(vectors: DataFrame) -> DataFrame:
    """(x, y) by principal components; each axis points to its largest loading."""
    features = vectors.withColumn("_features", array_to_vector("vec"))
    model = PCA(k=2, inputCol="_features", outputCol="_plane").fit(features)
    loadings = model.pc.toArray()
    signs = [float(np.sign(axis[np.argmax(np.abs(axis))])) or 1.0 for axis in loadings.T]
    means = vectors.select(F.posexplode("vec").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    center = [row["m"] for row in means.orderBy("dim").collect()]
    shift = np.asarray(center) @ loadings
    # The centre and both axes have one number per dimension, not per row.
    return _centred(model.transform(features), signs, shift)


def _centred(projected: DataFrame, signs: list[float], shift) -> DataFrame:
    point = vector_to_array("_plane")
    return projected.withColumns(
        {
            "x": (F.get(point, F.lit(0)) - float(shift[0])) * signs[0],
            "y": (F.get(point, F.lit(1)) - float(shift[1])) * signs[1],
        }
    ).drop("_features", "_plane")


def coordinate_ranges(points: DataFrame) -> DataFrame:
    return points.agg(
        (F.max("x") - F.min("x")).alias("range_x"), (F.max("y") - F.min("y")).alias("range_y")
    )


def labelled_points(points: DataFrame) -> DataFrame:
    """Add language, keyword and the label position of a map."""
    range_x = points.select((F.max("x") - F.min("x"))).scalar()
    return points.select(
        "token",
        label_language(F.col("token")).alias("language"),
        label_keyword(F.col("token")).alias("keyword"),
        "x",
        "y",
        (F.col("x") + 0.005 * range_x).alias("label_x"),
    )


def word_map(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Known words of a list on a plane: token, language, keyword, x, y."""
    known = word_vectors(known_words(words, vectors), vectors)
    points = durable(plane(unit_vectors(known)).select("token", "x", "y"), "points")
    return labelled_points(points)
