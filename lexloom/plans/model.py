"""The given tables read as a code corpus.

Every frame here has a twin of the same name in CTES, written in plain SQL, so
that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import lexis
from lexloom.functions.text import byte_length, content_hash
from lexloom.operators.profile import tokenise
from lexloom.operators.store import first_arrivals, latest_progress, rank_within
from lexloom.sources.corpus import spread

# Document language to the programming language it stands for.
LANGUAGE_OF = {"en": "Python", "de": "C++", "es": "C#", "fr": "Go"}
# Extension by source number, the fourth one being no extension at all.
EXTENSIONS = [".py", ".cpp", ".cs", "", ".go"]
# Words that play the part of shared keywords in prose.
PROSE_KEYWORDS = [
    "en", "de", "la", "the", "mit", "to", "of", "as", "with", "that", "license",
    "version",
]
FILES_PER_PAGE = 30

# Prose to code-shaped text, per language: what to find and what to write.
# <1> and <2> stand for the captured groups.
CODE_SHAPES = {
    "C++": [
        (r"([a-z]+) ([a-z]+)\.", "int <1> = <2> + 0x1F; // <2>\n<1>['q'] = \"<2>\\\"\";"),
        (r"([a-z]+), ", "float <1> = 1.5f; /* <1> */ if (<1> >= true) { return 10_km; } "),
        (r"^", "#include <lib>\n#define A(x) \\\n  x\nint main() {\n"),
        (r"$", "\n}\n"),
    ],
    "C#": [
        (r"([a-z]+) ([a-z]+)\.", "var <1> = $\"x{<2>}\" + 0b1; // <2>\nvoid <2>(int <1>, bool b)"),
        (r"([a-z]+), ", "char <1> = 'q'; <1> ??= false; /* <1> */ 0.Equals(2.5e3f); "),
        (r"^", "#region all\nclass A {\n"),
        (r"$", "\n}\n"),
    ],
    "Go": [
        (r"([a-z]+) ([a-z]+)\.", "<1>, <2> := `raw`, 'a' + 2i // <2>\nvar <1> = 1.5\nfunc <2>(<1> int) {"),
        (r"([a-z]+), ", "<1> := \"q\"\n}\nfor <1> := range <1> { <1>++ }\n/* a\nb */ return nil; "),
        (r"^", "package m\n\nimport (\n\"fmt\"\n)\n"),
        (r"$", "\n"),
    ],
    "Python": [
        (r"([a-z]+) ([a-z]+)\.", "\n<1> = \"x\" 'y'  # <2>\ndef <2>(<1>, b=1):\n    self.<1> = 0x1f + 2.5\n"),
        (r"([a-z]+), ", "\nwith open('''a'b''') as <1>:\n    <1> = [1,\n\n 2j] \\\n + True\nif <1>: "),
        (r"^", "#!/usr/bin/env python3\n\n"),
        (r"$", "\n"),
    ],
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chosen(column: Column, values: dict[str, str]) -> Column:
    picked = F.lit(None).cast("string")
    for key, value in values.items():
        picked = F.when(column == key, value).otherwise(picked)
    return picked


def _sql_choice(column: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items())
    return f"CASE {column} {cases} END"


# --- frames ------------------------------------------------------------------


def code(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as the corpus table, `page` being the page of arrival."""
    docs = table(spark, sf, "documents")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]),
        (F.substring(F.col("source"), 4, 9).cast("int") % len(EXTENSIONS)) + 1,
    )
    return docs.select(
        F.col("doc_id").alias("id"),
        chosen(F.col("lang"), LANGUAGE_OF).alias("language"),
        F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("url"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("hash"),
        byte_length(F.col("text")).alias("size"),
        F.floor(F.col("doc_id") / FILES_PER_PAGE).alias("page"),
    )


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as files of running text."""
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", chosen(F.col("lang"), LANGUAGE_OF).alias("language"), F.col("text").alias("content")
    )


def _whole_words(pattern: str) -> str:
    """The same matches, tried once at the beginning of each run of letters."""
    return pattern.replace("([a-z]+)", "(?<![a-z])([a-z]++)", 1).replace("([a-z]+)", "([a-z]++)")


def shaped(text: Column, language: str) -> Column:
    for pattern, written in CODE_SHAPES[language]:
        escaped = written.replace("\\", "\\\\").replace("$", "\\$")
        for n in ("1", "2"):
            escaped = escaped.replace(f"<{n}>", f"${n}")
        if pattern == "^":
            text = F.concat(F.lit(written), text)
        elif pattern == "$":
            text = F.concat(text, F.lit(written))
        else:
            text = F.regexp_replace(text, _whole_words(pattern), escaped)
    return text


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` rewritten as code in four languages, `pages` as HTML."""
    docs = prose(spark, sf)
    content = F.lit(None).cast("string")
    for language in CODE_SHAPES:
        content = F.when(F.col("language") == language, shaped(F.col("content"), language)).otherwise(content)
    pages = table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.lit("HTML").alias("language"), F.col("html").alias("content")
    )
    return docs.select("doc_id", "language", content.alias("content")).unionByName(pages)


def prose_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenise(prose(spark, sf), generic=True)


def code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenise(code_files(spark, sf))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """`conversations` as the write history of crawl progress."""
    return table(spark, sf, "conversations").select(
        F.col("role").alias("language"),
        F.col("conv_id").cast("string").alias("query"),
        F.col("turn").alias("last_page"),
        F.col("turn").alias("seq"),
    )


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return latest_progress(history(spark, sf))


def other_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of a second crawl: who opened each conversation and how many
    turns it has, and one finished query per labelled document."""
    talks = table(spark, sf, "conversations")
    opened = talks.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("language"), F.count("*").alias("last_page")
    )
    labels = table(spark, sf, "labels")
    return opened.select(
        "language", F.col("conv_id").cast("string").alias("query"), "last_page"
    ).unionByName(
        labels.select(
            F.lit("label").alias("language"),
            F.col("doc_id").cast("string").alias("query"),
            F.lit(-1).cast("long").alias("last_page"),
        )
    )


def curated(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled part of the corpus, one row per hash: a merge target."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return first_arrivals(code(spark, sf).drop("page").join(labels, "id", "left_semi"))


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and benchmark text: a merge source."""
    benchmark = table(spark, sf, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("id"),
        F.lit("Python").alias("language"),
        F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".py")).alias("url"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("hash"),
        byte_length(F.col("text")).alias("size"),
    )
    return code(spark, sf).drop("page").unionByName(benchmark)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """`embeddings` as word vectors, labelled `language_keyword` for the four
    languages and `keyword_label_rest` for the others."""
    ranked = rank_within(table(spark, sf, "embeddings"), "label", "vec_id", "_rank")
    names = dict(enumerate(LANGUAGE_OF.values()))
    language = F.lit(None).cast("string")
    for label, name in names.items():
        language = F.when(F.col("label") == label, name).otherwise(language)
    keyword = F.concat(F.lit("k"), F.col("_rank").cast("string"))
    return ranked.select(
        "vec_id",
        language.alias("language"),
        keyword.alias("keyword"),
        F.coalesce(
            F.concat(language, F.lit("_"), keyword),
            F.concat(keyword, F.lit("_"), F.col("label").cast("string"), F.lit("_rest")),
        ).alias("token"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


# --- the same frames as SQL --------------------------------------------------


def sql_generic(text: str) -> str:
    folded = f"lower({text})"
    for pattern, written in lexis.GENERIC_REPLACEMENTS:
        folded = f"regexp_replace({folded}, {quoted(lexis.greedy(pattern))}, {quoted(written)}, 'g')"
    return f"regexp_extract_all({folded}, {quoted(lexis.greedy(lexis.GENERIC_TOKEN))}, 0)"


def _sql_shaped(text: str, language: str) -> str:
    for pattern, written in CODE_SHAPES[language]:
        if pattern == "^":
            text = f"{quoted(written)} || {text}"
        elif pattern == "$":
            text = f"{text} || {quoted(written)}"
        else:
            escaped = written.replace("\\", "\\\\")
            for n in ("1", "2"):
                escaped = escaped.replace(f"<{n}>", f"\\{n}")
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(escaped)}, 'g')"
    return text


_EXT = "[" + ", ".join(quoted(e) for e in EXTENSIONS) + "]"


def _sql_found(language: str) -> str:
    pattern = {
        "C++": lexis.CPP_TOKEN,
        "C#": lexis.CSHARP_TOKEN,
        "Go": lexis.GO_TOKEN,
        "Python": lexis.PYTHON_TOKEN,
    }[language]
    return f"regexp_extract_all(content, {quoted(lexis.greedy(pattern))}, 0)"


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(lexis.greedy(pattern))})"


_IS_BREAK = "(substr(t, 1, 1) IN (chr(10), chr(13)) OR (starts_with(t, '/*') AND regexp_matches(t, '[\\r\\n]')))"

# Folded tokens of each language, before line ends are settled.
_FOLDED_SQL = f"""
  SELECT doc_id, language, p, CASE language
    WHEN 'C++' THEN CASE
      WHEN right(t, 1) IN ('"', '''') THEN 'STRING_LITERAL'
      WHEN t IN ('true', 'false') THEN 'BOOL_LITERAL'
      WHEN {_matches('t', lexis.NUMBER_START)} AND {_matches('t', lexis.CPP_INTEGER_LITERAL)} THEN 'INT_LITERAL'
      WHEN {_matches('t', lexis.NUMBER_START)} AND {_matches('t', lexis.CPP_FLOAT_LITERAL)} THEN 'FLOAT_LITERAL'
      ELSE t END
    WHEN 'C#' THEN CASE
      WHEN right(t, 1) IN ('"', '''') THEN 'STRING_LITERAL'
      WHEN t IN ('true', 'false') THEN 'BOOL_LITERAL'
      WHEN {_matches('t', lexis.CSHARP_ACCESS)} THEN t
      WHEN {_matches('t', lexis.CSHARP_REAL_LITERAL)} THEN 'FLOAT_LITERAL'
      WHEN {_matches('t', lexis.NUMBER_START)} THEN 'INT_LITERAL'
      ELSE t END
    WHEN 'Go' THEN CASE
      WHEN {_IS_BREAK} THEN chr(10)
      WHEN substr(t, 1, 1) IN ('"', '`') THEN 'STRING_LITERAL'
      WHEN substr(t, 1, 1) = '''' THEN 'INT_LITERAL'
      WHEN {_matches('t', lexis.GO_FLOAT_LITERAL)} THEN 'FLOAT_LITERAL'
      WHEN {_matches('t', lexis.NUMBER_START)} THEN 'INT_LITERAL'
      ELSE t END
    WHEN 'Python' THEN CASE
      WHEN right(t, 1) IN ('"', '''') AND length(t) > 1 THEN 'STRING_LITERAL'
      WHEN t IN ('True', 'False') THEN 'BOOL_LITERAL'
      WHEN {_matches('t', lexis.NUMBER_START)} THEN 'FLOAT_LITERAL'
      WHEN substr(t, 1, 1) IN (chr(10), chr(13), chr(12)) THEN chr(10)
      ELSE t END
    ELSE t END AS token
  FROM found
  WHERE CASE language
    WHEN 'C++' THEN substr(t, 1, 2) NOT IN ('//', '/*') AND substr(t, 1, 1) <> '#'
    WHEN 'C#' THEN substr(t, 1, 2) NOT IN ('//', '/*') AND substr(t, 1, 1) <> '#'
    WHEN 'Go' THEN substr(t, 1, 2) NOT IN ('//', '/*') OR {_IS_BREAK}
    WHEN 'Python' THEN substr(t, 1, 1) NOT IN ('#', '\\') OR t = '\\'
    ELSE true END
"""

_GO_OPEN = ", ".join(quoted(w) for w in lexis.GO_OPEN_KEYWORDS)
_GO_MARKS = ", ".join(quoted(w) for w in lexis.GO_CLOSING_MARKS)

CTES: dict[str, str] = {
    "code": f"""
  SELECT doc_id AS id, {_sql_choice('lang', LANGUAGE_OF)} AS language,
    'src/' || source || '/' || doc_id || {_EXT}[(CAST(substr(source, 4) AS INT) % {len(EXTENSIONS)}) + 1] AS url,
    text AS content, sha1(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size,
    doc_id // {FILES_PER_PAGE} AS page
  FROM documents""",
    "prose": f"SELECT doc_id, {_sql_choice('lang', LANGUAGE_OF)} AS language, text AS content FROM documents",
    "code_files": "SELECT doc_id, language, CASE language "
    + " ".join(f"WHEN {quoted(name)} THEN {_sql_shaped('content', name)}" for name in CODE_SHAPES)
    + " END AS content FROM prose UNION ALL SELECT -1 - page_id, 'HTML', html FROM pages",
    "prose_tokens": f"SELECT doc_id, language, {sql_generic('content')} AS tokens FROM prose",
    "tok": "SELECT doc_id, language, unnest(tokens) AS token, "
    "CAST(generate_subscripts(tokens, 1) - 1 AS INT) AS pos FROM prose_tokens",
    "freq": "SELECT language, token, count(*) AS freq FROM tok GROUP BY ALL",
    "total": "SELECT token, count(*) AS freq FROM tok GROUP BY ALL",
    "found": "SELECT doc_id, language, unnest(f) AS t, generate_subscripts(f, 1) AS p FROM ("
    "SELECT doc_id, language, CASE language "
    + " ".join(f"WHEN {quoted(name)} THEN {_sql_found(name)}" for name in CODE_SHAPES)
    + f" ELSE {sql_generic('content')} END AS f FROM code_files)",
    "folded": _FOLDED_SQL,
    "code_tok": f"""
  SELECT doc_id, language, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INT) AS pos, token
  FROM (
    SELECT *, lag(token) OVER file AS prev,
      coalesce(sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
    FROM folded WINDOW file AS (PARTITION BY doc_id ORDER BY p))
  WHERE CASE WHEN token <> chr(10) THEN true
    WHEN language = 'Go' THEN coalesce(prev IN ({_GO_MARKS})
      OR (regexp_matches(prev, '^[\\p{{L}}_]') AND prev NOT IN ({_GO_OPEN})), false)
    WHEN language = 'Python' THEN depth <= 0 AND coalesce(prev <> chr(10), true)
    ELSE true END""",
    "code_freq": "SELECT language, token, count(*) AS freq FROM code_tok GROUP BY ALL",
    "history": "SELECT role AS language, CAST(conv_id AS VARCHAR) AS query, turn AS last_page, turn AS seq FROM conversations",
    "progress": "SELECT language, query, arg_max(last_page, seq) AS last_page FROM history GROUP BY ALL",
    "other_progress": """
  SELECT language, CAST(conv_id AS VARCHAR) AS query, last_page FROM (
    SELECT conv_id, arg_min(role, turn) AS language, count(*) AS last_page FROM conversations GROUP BY conv_id)
  UNION ALL SELECT 'label', CAST(doc_id AS VARCHAR), -1 FROM labels""",
    "curated": """
  SELECT id, language, url, content, hash, size FROM (
    SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM code
    WHERE id IN (SELECT doc_id FROM labels)) WHERE r = 1""",
    "crawled": """
  SELECT id, language, url, content, hash, size FROM code
  UNION ALL SELECT item_id + 1000000000, 'Python', 'bench/' || item_id || '.py', text, sha1(text),
    CAST(octet_length(encode(text)) AS BIGINT) FROM benchmark""",
    "vectors": f"""
  SELECT vec_id, language, keyword,
    coalesce(language || '_' || keyword, keyword || '_' || label || '_rest') AS token, vec
  FROM (SELECT vec_id, label, CASE label {' '.join(f"WHEN {n} THEN {quoted(v)}" for n, v in enumerate(LANGUAGE_OF.values()))} END AS language,
    'k' || row_number() OVER (PARTITION BY label ORDER BY vec_id) AS keyword,
    CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)""",
    "units": """
  SELECT *, CASE WHEN len0 > 0 THEN list_transform(vec, lambda x: x / len0) ELSE vec END AS u
  FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS len0 FROM vectors)""",
}

NEEDS = {
    "code_files": ["prose"],
    "prose_tokens": ["prose"],
    "tok": ["prose_tokens"],
    "freq": ["tok"],
    "total": ["tok"],
    "found": ["code_files"],
    "folded": ["found"],
    "code_tok": ["folded"],
    "code_freq": ["code_tok"],
    "progress": ["history"],
    "curated": ["code"],
    "crawled": ["code"],
    "units": ["vectors"],
}


def with_frames(body: str, *names: str, **extra: str) -> str:
    """`body` after WITH clauses for the named frames and what they need.

    `extra` frames follow in the order given.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    clauses = [f"{name} AS ({CTES[name]})" for name in ordered]
    clauses += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body
