"""Tokenisers, text functions and token statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import lexis, text
from lexloom.operators import declared, frames, profile, similarity, store
from lexloom.plans import declared_sql, model
from lexloom.plans.model import PROSE_KEYWORDS, quoted, with_frames
from lexloom.plans.registry import query
from lexloom.schema import FREQUENCY_STEPS, KEYWORD_COUNTS, fixed_rows, keyword_rows
from lexloom.session import durable

LANGUAGES = ["C++", "Go", "C#", "Python"]
SEED = 42


def _words(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.token_rows(model.prose_tokens(spark, sf))


def _code_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.token_rows(model.code_tokens(spark, sf))


# --- text functions ----------------------------------------------------------


@query("f01_lower_case", "SELECT doc_id, lower(text) AS lowered FROM documents")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return model.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lowered"))


def _folded_sql(column: str) -> str:
    folded = f"lower({column})"
    for pattern, written in lexis.GENERIC_REPLACEMENTS:
        folded = f"regexp_replace({folded}, {quoted(lexis.greedy(pattern))}, {quoted(written)}, 'g')"
    return folded


@query("f02_replace_literals", f"SELECT page_id, {_folded_sql('html')} AS folded FROM pages")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    folded = lexis.replace_all(F.lower("html"), lexis.GENERIC_REPLACEMENTS)
    return model.table(spark, sf, "pages").select("page_id", folded.alias("folded"))


@query(
    "f03_find_all",
    f"SELECT page_id, len(found) AS n, array_to_string(found, ' ') AS found FROM (SELECT page_id, "
    f"regexp_extract_all(html, {quoted(lexis.greedy(lexis.GENERIC_TOKEN))}, 0) AS found FROM pages)",
)
def f03(spark: SparkSession, sf: str) -> DataFrame:
    found = lexis.find_all(F.col("html"), lexis.GENERIC_TOKEN)
    return (
        model.table(spark, sf, "pages")
        .select("page_id", found.alias("found"))
        .select("page_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("found"))
    )


@query(
    "f04_content_hash",
    "SELECT doc_id, sha1(text) AS hash, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob FROM documents",
)
def f04(spark: SparkSession, sf: str) -> DataFrame:
    content = F.col("text")
    return model.table(spark, sf, "documents").select(
        "doc_id", text.content_hash(content).alias("hash"), text.blob_id(content).alias("blob")
    )


@query(
    "f05_byte_length",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents",
)
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return model.table(spark, sf, "documents").select("doc_id", text.byte_length(F.col("text")).alias("size"))


@query(
    "f06_epoch_text",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN props "
    "ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS stamp FROM events",
)
def f06(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).cast("string")
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(seconds)
    return model.table(spark, sf, "events").select("event_id", text.epoch_text(raw).alias("stamp"))


@query(
    "f07_language_prefix",
    with_frames(
        "SELECT doc_id, array_to_string(list_transform(tokens, lambda t: CASE WHEN t IN "
        f"({_words(PROSE_KEYWORDS)}) THEN language || '_' || t ELSE t END), ' ') AS tokens FROM prose_tokens",
        "prose_tokens",
    ),
)
def f07(spark: SparkSession, sf: str) -> DataFrame:
    prefixed = text.prefix_words(F.col("tokens"), F.col("language"), PROSE_KEYWORDS)
    return model.prose_tokens(spark, sf).select("doc_id", F.array_join(prefixed, " ").alias("tokens"))


@query(
    "f08_split_label",
    with_frames(
        "SELECT token, CASE WHEN len(string_split(token, '_')) = 2 THEN string_split(token, '_')[1] ELSE '' END AS language, "
        "CASE WHEN len(string_split(token, '_')) = 2 THEN string_split(token, '_')[2] ELSE token END AS keyword FROM vectors",
        "vectors",
    ),
)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    token = F.col("token")
    return model.vectors(spark, sf).select(
        "token", text.label_language(token).alias("language"), text.label_keyword(token).alias("keyword")
    )


@query(
    "f09_join_tokens",
    with_frames(
        "SELECT doc_id, replace(array_to_string(tokens, ' '), ':', ':' || chr(10)) AS document FROM prose_tokens",
        "prose_tokens",
    ),
)
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return model.prose_tokens(spark, sf).select("doc_id", text.joined_document(F.col("tokens")).alias("document"))


@query("f10_strip_dots", "SELECT page_id, replace(url, '.', '') AS stripped FROM pages")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return model.table(spark, sf, "pages").select("page_id", text.strip_dots(F.col("url")).alias("stripped"))


@query(
    "f11_token_count",
    with_frames("SELECT doc_id, CAST(len(tokens) AS BIGINT) AS tokens FROM prose_tokens", "prose_tokens"),
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return model.prose_tokens(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("tokens"))


def _draw_sql(seed: int) -> str:
    return f"md5(CAST(doc_id AS VARCHAR) || ':{seed}')"


_SAMPLE_SQL = f"SELECT * FROM prose_tokens ORDER BY {_draw_sql(SEED)}, doc_id LIMIT 5"


@query(
    "f12_concatenate_lists",
    with_frames(
        "SELECT array_to_string(flatten(list(tokens ORDER BY doc_id)), ' ') AS tokens FROM sample",
        "prose_tokens",
        sample=_SAMPLE_SQL,
    ),
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    sample = profile.sample_files(model.prose(spark, sf), 5, SEED)
    whole = profile.concatenated(profile.tokenise(sample, generic=True))
    return whole.select(F.array_join("tokens", " ").alias("tokens"))


# --- tokenisers --------------------------------------------------------------


@query(
    "t01_generic_tokeniser",
    with_frames(
        "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, array_to_string(tokens, ' ') AS tokens FROM "
        f"(SELECT doc_id, tokens FROM prose_tokens UNION ALL SELECT -1 - page_id, {model.sql_generic('html')} FROM pages)",
        "prose_tokens",
    ),
)
def t01(spark: SparkSession, sf: str) -> DataFrame:
    pages = model.table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.lit("HTML").alias("language"), F.col("html").alias("content")
    )
    tokenised = profile.tokenise(model.prose(spark, sf).unionByName(pages), generic=True)
    return tokenised.select(
        "doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


_CODE_TEXT_SQL = (
    "SELECT doc_id, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS tokens FROM code_tok {where} GROUP BY doc_id"
)


def _tokens_of(spark: SparkSession, sf: str, language: str) -> DataFrame:
    files = store.of_language(model.code_files(spark, sf), language)
    tokens = lexis.TOKENISERS[language](F.col("content"))
    return files.select("doc_id", tokens.alias("tokens")).select(
        "doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


def _lexis_check(language: str) -> str:
    return with_frames(_CODE_TEXT_SQL.format(where=f"WHERE language = '{language}'"), "code_tok")


@query("t02_cpp_tokens", _lexis_check("C++"))
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_of(spark, sf, "C++")


@query("t03_csharp_tokens", _lexis_check("C#"))
def t03(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_of(spark, sf, "C#")


@query("t04_go_tokens", _lexis_check("Go"))
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_of(spark, sf, "Go")


@query("t05_python_tokens", _lexis_check("Python"))
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens_of(spark, sf, "Python")


@query(
    "t06_dispatch_by_language",
    with_frames(
        "SELECT doc_id, language, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS tokens FROM code_tok GROUP BY ALL",
        "code_tok",
    ),
)
def t06(spark: SparkSession, sf: str) -> DataFrame:
    return model.code_tokens(spark, sf).select(
        "doc_id", "language", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


@query(
    "t07_mask_declared_names",
    with_frames(
        "SELECT doc_id, language, count(*) AS n, string_agg(CASE WHEN hidden THEN 'VARIABLE' ELSE token END, ' ' ORDER BY pos) AS tokens "
        "FROM masked GROUP BY ALL",
        "code_tok",
        masked=declared_sql.masked_sql(
            "code_tok", lambda column, pattern: f"regexp_matches({column}, {quoted(pattern)})"
        ),
    ),
)
def t07(spark: SparkSession, sf: str) -> DataFrame:
    return declared.masked_tokens(model.code_tokens(spark, sf)).select(
        "doc_id", "language", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens")
    )


@query("t08_token_table", with_frames("SELECT doc_id, language, pos, token FROM tok", "tok"))
def t08(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf)


@query(
    "t09_keyword_balance",
    with_frames(
        "SELECT language, token, freq, round(freq / max(freq) OVER (PARTITION BY language), 6) AS ratio "
        f"FROM code_freq JOIN (VALUES {fixed_rows(keyword_rows())}) AS k(set_name, token) USING (token) WHERE set_name = 'common'",
        "code_freq",
    ),
)
def t09(spark: SparkSession, sf: str) -> DataFrame:
    frequency = profile.token_frequency(profile.keyword_rows_only(_code_rows(spark, sf)))
    return profile.keyword_balance(frequency).withColumn("ratio", F.round("ratio", 6))


# --- statistics --------------------------------------------------------------


@query("a03_files_per_language", with_frames("SELECT language, count(*) AS files FROM code GROUP BY language", "code"))
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return profile.files_per_language(model.code(spark, sf))


@query("a04_distinct_languages", with_frames("SELECT DISTINCT language FROM code", "code"))
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return model.code(spark, sf).select("language").distinct()


@query("a05_token_frequency", with_frames("SELECT * FROM freq", "freq"))
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return profile.token_frequency(_rows(spark, sf))


@query(
    "a06_different_tokens",
    with_frames("SELECT language, count(DISTINCT token) AS different_tokens FROM tok GROUP BY language", "tok"),
)
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return profile.different_tokens(_rows(spark, sf))


@query(
    "a07_vocabulary_sizes",
    with_frames(
        "SELECT language, min_freq, count(*) AS vocabulary FROM freq JOIN "
        f"(SELECT CAST(unnest([{', '.join(map(str, FREQUENCY_STEPS))}]) AS INT) AS min_freq) ON freq >= min_freq GROUP BY ALL",
        "freq",
    ),
)
def a07(spark: SparkSession, sf: str) -> DataFrame:
    return profile.vocabulary_sizes(profile.token_frequency(_rows(spark, sf)))


@query(
    "a08_average_tokens",
    with_frames("SELECT language, round(avg(len(tokens)), 2) AS avg_tokens FROM prose_tokens GROUP BY language", "prose_tokens"),
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return profile.average_tokens(model.prose_tokens(spark, sf))


@query("a09_vocabulary", with_frames("SELECT DISTINCT token FROM tok", "tok"))
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return profile.vocabulary(_rows(spark, sf))


@query("a10_min_count", with_frames("SELECT token, freq FROM total WHERE freq >= 10", "total"))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequent_tokens(_rows(spark, sf), 10)


@query(
    "a11_corpus_count",
    with_frames("SELECT count(*) AS corpus_count FROM prose_tokens WHERE language <> 'Go'", "prose_tokens"),
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return profile.training_files(model.prose(spark, sf), ignored=["Go"])


def _sheet_column(language: str) -> str:
    return f"max(value) FILTER (WHERE language = {quoted(language)}) AS \"{language}\""


_SHEET_SQL = f"""
  SELECT metric, {', '.join(_sheet_column(name) for name in LANGUAGES)} FROM (
    SELECT language, 'Avg. tokens per file' AS metric, CAST(round(avg(n), 2) AS VARCHAR) AS value
    FROM (SELECT doc_id, language, count(*) AS n FROM code_tok GROUP BY ALL) GROUP BY language
    UNION ALL SELECT language, ['Most frequent token', '2nd most frequent token', '3rd most frequent token'][r], token
    FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY freq DESC, token) AS r FROM code_freq) WHERE r <= 3
    UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(k)}, 'Number of keywords', '{v}')" for k, v in KEYWORD_COUNTS.items())}))
  GROUP BY metric"""


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    tokenised = cached_code_tokens(spark, sf)
    frequency = profile.token_frequency(profile.token_rows(tokenised))
    return profile.summary_sheet(tokenised, frequency, LANGUAGES)


def cached_code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens written once where a query reads them more than once."""
    return durable(model.code_tokens(spark, sf), "code_tokens")


@query("a12_summary_sheet", with_frames(_SHEET_SQL, "code_freq"))
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf)


@query(
    "f13_sheet_rows",
    with_frames(
        "SELECT metric, '| ' || metric || ' | ' || "
        + " || ' | ' || ".join(f"\"{name}\"" for name in LANGUAGES)
        + f" || ' |' AS line FROM ({_SHEET_SQL})",
        "code_freq",
    ),
)
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sheet_lines(_sheet(spark, sf), LANGUAGES)


@query(
    "w01_top_tokens",
    with_frames(
        "SELECT language, token, freq, rank FROM (SELECT *, CAST(row_number() OVER "
        "(PARTITION BY language ORDER BY freq DESC, token) AS INT) AS rank FROM freq) WHERE rank <= 10",
        "freq",
    ),
)
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_tokens(profile.token_frequency(_rows(spark, sf)), 10)


@query("o01_most_frequent", with_frames("SELECT token, freq FROM total ORDER BY freq DESC, token LIMIT 25", "total"))
def o01(spark: SparkSession, sf: str) -> DataFrame:
    return profile.most_frequent(profile.total_frequency(_rows(spark, sf)), 25)


@query("o02_sorted_vocabulary", with_frames("SELECT DISTINCT token FROM tok ORDER BY token", "tok"))
def o02(spark: SparkSession, sf: str) -> DataFrame:
    return profile.vocabulary(_rows(spark, sf)).orderBy("token")


@query("o03_seeded_sample", f"SELECT doc_id, text FROM documents ORDER BY {_draw_sql(SEED)}, doc_id LIMIT 5")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_files(model.table(spark, sf, "documents").select("doc_id", "text"), 5, SEED)


@query(
    "o04_train_test_split",
    f"SELECT doc_id, CASE WHEN CAST('0x' || substr({_draw_sql(0)}, 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM documents",
)
def o04(spark: SparkSession, sf: str) -> DataFrame:
    return profile.train_test(model.table(spark, sf, "documents").select("doc_id"))


@query(
    "u02_sampled_words",
    with_frames("SELECT DISTINCT unnest(tokens) AS token FROM sample", "prose_tokens", sample=_SAMPLE_SQL),
)
def u02(spark: SparkSession, sf: str) -> DataFrame:
    sample = profile.sample_files(model.prose(spark, sf), 5, SEED)
    return profile.vocabulary(profile.token_rows(profile.tokenise(sample, generic=True)))


@query(
    "u03_shared_and_exclusive_tokens",
    with_frames(
        "SELECT token, CASE WHEN n = 4 THEN 'shared' ELSE first_language END AS scope FROM "
        "(SELECT token, count(DISTINCT language) AS n, min(language) AS first_language FROM tok GROUP BY token) WHERE n IN (1, 4)",
        "tok",
    ),
)
def u03(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shared_tokens(_rows(spark, sf), len(LANGUAGES))


# --- vocabulary and frames ---------------------------------------------------


@query(
    "w05_vocabulary_index",
    with_frames(
        "SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM tok)", "tok"
    ),
)
def w05(spark: SparkSession, sf: str) -> DataFrame:
    return profile.vocabulary_index(_rows(spark, sf))


@query(
    "w06_context_frame",
    with_frames(
        "SELECT doc_id, CAST(i - 1 AS INT) AS pos, tokens[i] AS token, array_to_string("
        "list_concat(tokens[greatest(i - 5, 1):i - 1], tokens[i + 1:i + 5]), ' ') AS context "
        "FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM prose_tokens)",
        "prose_tokens",
    ),
)
def w06(spark: SparkSession, sf: str) -> DataFrame:
    framed = frames.context_frames(model.prose_tokens(spark, sf), 5)
    return framed.select("doc_id", "pos", "token", F.array_join("context", " ").alias("context"))


@query(
    "w07_recent_frame",
    with_frames(
        "SELECT doc_id, CAST(i - 1 AS INT) AS pos, tokens[i] AS token, "
        "array_to_string(tokens[greatest(i - 5, 1):i - 1], ' ') AS recent "
        "FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM prose_tokens)",
        "prose_tokens",
    ),
)
def w07(spark: SparkSession, sf: str) -> DataFrame:
    framed = frames.recent_frames(model.prose_tokens(spark, sf), 5)
    return framed.select("doc_id", "pos", "token", F.array_join("recent", " ").alias("recent"))


# --- keyword and word-list joins ---------------------------------------------

_BENCH_WORDS_SQL = f"SELECT DISTINCT unnest({model.sql_generic('text')}) AS token FROM benchmark"


def benchmark_tokens(spark: SparkSession, sf: str) -> DataFrame:
    files = model.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("Python").alias("language"), F.col("text").alias("content")
    )
    return profile.tokenise(files, generic=True)


@query(
    "j04_known_words",
    with_frames(
        "SELECT token FROM words WHERE token IN (SELECT token FROM total WHERE freq >= 10)",
        "total",
        words=_BENCH_WORDS_SQL,
    ),
)
def j04(spark: SparkSession, sf: str) -> DataFrame:
    words = profile.vocabulary(profile.token_rows(benchmark_tokens(spark, sf)))
    return similarity.known_words(words, profile.frequent_tokens(_rows(spark, sf), 10))


@query(
    "j07_keyword_members",
    with_frames(
        "SELECT set_name, language, token, freq FROM code_freq JOIN "
        f"(VALUES {fixed_rows(keyword_rows())}) AS k(set_name, token) USING (token)",
        "code_freq",
    ),
)
def j07(spark: SparkSession, sf: str) -> DataFrame:
    return profile.keyword_members(profile.token_frequency(profile.keyword_rows_only(_code_rows(spark, sf))))
