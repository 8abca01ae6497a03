"""Token tables and token statistics per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.lexis import generic_tokens, tokens_by_language
from lexloom.functions.text import sheet_row
from lexloom.operators.store import dense_index
from lexloom.schema import FREQUENCY_STEPS, KEYWORD_COUNTS, keyword_dim


def tokenise(
    files: DataFrame, ignored: list[str] | None = None, generic: bool = False
) -> DataFrame:
    """(doc_id, language, tokens) of (doc_id, language, content)."""
    content = F.col("content")
    tokens = (
        generic_tokens(content)
        if generic
        else tokens_by_language(F.col("language"), content, ignored)
    )
    return files.select("doc_id", "language", tokens.alias("tokens"))


def tokenise_document(spark: SparkSession, document: str, language: str | None) -> list[str] | None:
    """Tokens of one text: the corpus job on a table of one row."""
    files = spark.createDataFrame(
        [(0, language, document)], "doc_id long, language string, content string"
    )
    return tokenise(files).first()["tokens"]


def token_rows(tokenised: DataFrame) -> DataFrame:
    """One row per token: (doc_id, language, pos, token).

    The outer form keeps the planner from repeating the tokeniser in a
    "size(tokens) > 0" filter below the explode.
    """
    return tokenised.select(
        "doc_id", "language", F.posexplode_outer("tokens").alias("pos", "token")
    ).where(F.col("token").isNotNull())


# --- counts ------------------------------------------------------------------


def files_per_language(code: DataFrame) -> DataFrame:
    return (
        code.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")
    )


def token_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("language", "token").agg(F.count("*").alias("freq"))


def different_tokens(rows: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("token") if approximate else F.count_distinct("token")
    return rows.groupBy("language").agg(count.alias("different_tokens"))


def vocabulary_sizes(frequency: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """Tokens per language that occur at least `min_freq` times.

    Tokens are counted by the highest step they reach, which leaves at most one
    row per language and step to spread over the lower steps.
    """
    steps = steps or FREQUENCY_STEPS
    known = F.array(*[F.lit(step) for step in steps])
    reached = F.array_max(F.filter(known, lambda step: step <= F.col("freq")))
    by_highest = (
        frequency.where(F.col("freq") >= min(steps))
        .groupBy("language", reached.alias("_highest"))
        .agg(F.count("*").alias("_tokens"))
    )
    lower = F.filter(known, lambda step: step <= F.col("_highest"))
    return (
        by_highest.select("language", F.explode(lower).alias("min_freq"), "_tokens")
        .groupBy("language", "min_freq")
        .agg(F.sum("_tokens").alias("vocabulary"))
    )


def average_tokens(tokenised: DataFrame) -> DataFrame:
    return tokenised.groupBy("language").agg(
        F.round(F.avg(F.size("tokens")), 2).alias("avg_tokens")
    )


def training_files(files: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Number of files that tokenise to a list, told without tokenising them."""
    kept = files.where(F.col("language").isNotNull() & F.col("content").isNotNull())
    if ignored:
        kept = kept.where(~F.col("language").isin(ignored))
    return kept.agg(F.count("*").alias("corpus_count"))


# --- vocabulary --------------------------------------------------------------


def vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select("token").distinct()


def total_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(F.count("*").alias("freq"))


def frequent_tokens(rows: DataFrame, min_count: int = 10) -> DataFrame:
    return total_frequency(rows).where(F.col("freq") >= min_count)


def vocabulary_index(rows: DataFrame) -> DataFrame:
    """(token, idx): sorted tokens numbered from 0, to look up either way."""
    return dense_index(vocabulary(rows), [F.col("token")], "idx")


def shared_tokens(rows: DataFrame, languages: int) -> DataFrame:
    """Tokens of every one of `languages` languages, and tokens of just one."""
    spread_over = rows.groupBy("token").agg(
        F.count_distinct("language").alias("languages"), F.min("language").alias("first_language")
    )
    return (
        spread_over.where(F.col("languages").isin(1, languages))
        .withColumn("scope", F.when(F.col("languages") == languages, "shared").otherwise(F.col("first_language")))
        .select("token", "scope")
    )


# --- rankings ----------------------------------------------------------------


def top_tokens(frequency: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent tokens per language, equal counts by token."""
    ranking = Window.partitionBy("language").orderBy(F.desc("freq"), "token")
    return frequency.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def most_frequent(frequency: DataFrame, n: int) -> DataFrame:
    return frequency.orderBy(F.desc("freq"), "token").limit(n)


# --- summary sheet -----------------------------------------------------------


def summary_sheet(tokenised: DataFrame, frequency: DataFrame, languages: list[str]) -> DataFrame:
    """Metrics as rows, languages as columns."""
    average = average_tokens(tokenised).select(
        "language",
        F.lit("Avg. tokens per file").alias("metric"),
        F.col("avg_tokens").cast("string").alias("value"),
    )
    names = {1: "Most frequent token", 2: "2nd most frequent token", 3: "3rd most frequent token"}
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    top = top_tokens(frequency, 3).select(
        "language", labels[F.col("rank")].alias("metric"), F.col("token").alias("value")
    )
    counts = F.create_map(*[F.lit(x) for pair in KEYWORD_COUNTS.items() for x in pair])
    keywords = average.select(
        "language",
        F.lit("Number of keywords").alias("metric"),
        counts[F.col("language")].cast("string").alias("value"),
    )
    return (
        average.unionByName(top)
        .unionByName(keywords)
        .groupBy("metric")
        .pivot("language", languages)
        .agg(F.first("value"))
    )


def sheet_lines(sheet: DataFrame, languages: list[str]) -> DataFrame:
    cells = [F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in languages]
    return sheet.select("metric", sheet_row(F.col("metric"), *cells).alias("line"))


# --- keywords ----------------------------------------------------------------


def keyword_rows_only(rows: DataFrame) -> DataFrame:
    """Rows of tokens that belong to a keyword set.

    Before counting, so that only keywords are shuffled; the broadcast side is
    the fixed list of keywords.
    """
    words = keyword_dim(rows.sparkSession).select("token").distinct()
    return rows.join(F.broadcast(words), "token", "left_semi")


def keyword_members(frequency: DataFrame) -> DataFrame:
    """Counted tokens that belong to a keyword set, once per set."""
    return frequency.join(keyword_dim(frequency.sparkSession), "token")


def keyword_balance(frequency: DataFrame, set_name: str = "common") -> DataFrame:
    """Keyword counts and their ratio to the language's most used keyword."""
    members = keyword_members(frequency).where(F.col("set_name") == set_name)
    per_language = Window.partitionBy("language")
    return members.select(
        "language",
        "token",
        "freq",
        (F.col("freq") / F.max("freq").over(per_language)).alias("ratio"),
    )


# --- samples -----------------------------------------------------------------


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))


def sample_files(df: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """The same n files for the same seed, however the data is partitioned."""
    return df.orderBy(_draw(seed), "doc_id").limit(n)


def train_test(df: DataFrame, test_percent: int = 20, seed: int = 0) -> DataFrame:
    """Mark each file as train or test by a hash of its id."""
    bucket = F.conv(F.substring(_draw(seed), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(bucket < test_percent, "test").otherwise("train"))


def concatenated(tokenised: DataFrame, order: str = "doc_id") -> DataFrame:
    """Token lists of a sample as one list; meant for `sample_files` output."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "tokens")))
    return tokenised.agg(F.flatten(F.transform(ordered, lambda s: s["tokens"])).alias("tokens"))
