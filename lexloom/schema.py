"""Table schemas and the fixed dimension tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("last_page", T.IntegerType()),
    ]
)

SNIPPETS = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("snippet", T.StringType()),
    ]
)

# Size cap of one file in bytes (a file of exactly this size
# passes), and the page number that marks a finished query.
MAX_FILE_BYTES = 262_144
FINISHED_PAGE = -1

# Canonical language, accepted aliases (lower case), extensions.
LANGUAGES = [
    ("Python", ["python", "python3", "py", "py3"], [".py", ".py3"]),
    ("Go", ["go", "golang"], [".go"]),
    ("C#", ["c#", "csharp"], [".cs"]),
    (
        "C++",
        ["c++", "cpp"],
        [".cpp", ".hpp", ".cxx", ".hxx", ".cc", ".hh", ".C", ".H", ".c", ".h"],
    ),
    ("C", ["c"], [".c", ".h"]),
    ("Java", ["java"], [".java"]),
    ("JavaScript", ["javascript", "js"], [".js"]),
    ("Kotlin", ["kotlin", "kt"], [".kt"]),
]

# Word lists of the keyword study.
KEYWORD_SETS = {
    "common": [
        "if", "else", "for", "while", "class", "struct", "return", "continue",
        "break", "var", "try", "catch", "except",
    ],
    "semantic": ["{", "}", ":"],
    "inserted": ["INT_LITERAL", "FLOAT_LITERAL", "STRING_LITERAL", "VARIABLE"],
    "math": ["+", "-", "*", "/", "%", "&&", "||", "!", "&", "|"],
    "Python": [
        "def", "class", "return", "if", "else", "for", "while", "in", "import",
        "from", "as", "with", "try", "except", "finally", "raise", "assert",
        "yield", "lambda", "pass", "break", "continue", "del", "global",
        "nonlocal", "and", "or", "not", "is", "True", "False", "None", "async",
        "await",
    ],
    "C++": [
        "class", "bool", "catch", "try", "break", "continue", "delete", "do",
        "else", "enum", "explicit", "export", "extern", "false", "for", "friend",
        "goto", "if", "inline", "mutable", "namespace", "new", "operator",
        "private", "protected", "public", "register", "return", "sizeof",
        "static", "struct", "switch", "template", "this", "throw", "true",
        "typedef", "typeid", "typename", "union", "using", "virtual",
        "volatile", "while",
    ],
    "Go": [
        "break", "func", "default", "type", "defer", "go", "struct", "map",
        "chan", "else", "goto", "package", "range", "const", "fallthrough",
        "for", "import", "interface", "return", "select", "case", "continue",
        "if", "switch", "var", "nil", "true", "false",
    ],
}
KEYWORD_SETS["C#"] = KEYWORD_SETS["C++"]

# Words that get a language prefix before training.
PREFIXED_WORDS = KEYWORD_SETS["common"] + KEYWORD_SETS["semantic"]

# Keyword counts printed on the summary sheet.
KEYWORD_COUNTS = {"C++": 95, "Go": 25, "C#": 79, "Python": 33}

# Minimum frequencies at which vocabulary size is reported.
FREQUENCY_STEPS = [
    10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 120, 140, 160, 180, 200, 250, 300,
    350, 400, 450, 500, 600, 700, 800, 900, 1000,
]


def language_aliases() -> list[tuple[str, str]]:
    """(alias, language) pairs."""
    return [(alias, name) for name, aliases, _ in LANGUAGES for alias in aliases]


def language_extensions() -> list[tuple[str, str]]:
    """(language, ext) pairs, extensions without dots."""
    return [
        (name, ext.replace(".", "")) for name, _, exts in LANGUAGES for ext in exts
    ]


def keyword_rows() -> list[tuple[str, str]]:
    """(set_name, token) pairs."""
    return [
        (name, token)
        for name, tokens in KEYWORD_SETS.items()
        for token in dict.fromkeys(tokens)
    ]


def fixed_rows(rows: list[tuple[str, ...]]) -> str:
    """Rows as the body of a SQL VALUES clause."""
    return ", ".join("(" + ", ".join(f"'{value}'" for value in row) + ")" for row in rows)


def _fixed_table(spark: SparkSession, rows: list[tuple[str, ...]], names: str) -> DataFrame:
    # An inline relation has an exact size, so joins with it broadcast unasked.
    return spark.sql(f"SELECT * FROM VALUES {fixed_rows(rows)} AS t({names})")


def alias_dim(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, language_aliases(), "alias, language")


def extension_dim(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, language_extensions(), "language, ext")


def keyword_dim(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, keyword_rows(), "set_name, token")
