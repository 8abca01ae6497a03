"""SQL twin of the masking of declared names, for the check.

Declarations are found with windows over the token table: from neighbouring
tokens, from the statement or line a token stands in, and from the bracket around
it. The steps are lists of (column, SQL expression); each list may use the columns
of those before it. The operator finds the same names with array passes.
"""

from __future__ import annotations

from lexloom.operators.declared import (
    ASCII_NAME,
    CPP_TYPES,
    CSHARP_TYPES,
    GO_TYPE_STARTS,
    LITERALS,
    PYTHON_ASSIGNMENTS,
    PYTHON_CLAUSE_ENDS,
    RESERVED,
    UNICODE_NAME,
)


def _words(words: list[str]) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


NAME_PATTERNS = {"C++": ASCII_NAME, "C#": UNICODE_NAME, "Go": UNICODE_NAME, "Python": UNICODE_NAME}


def _by_language(choices: dict[str, str], otherwise: str) -> str:
    cases = " ".join(f"WHEN '{language}' THEN {choice}" for language, choice in choices.items())
    return f"CASE language {cases} ELSE {otherwise} END"


def name_test(matches) -> str:
    """Whether a token is a name that can be declared; `matches(column, pattern)` is the engine's regex test."""
    return _by_language(
        {
            language: f"({matches('token', pattern)} AND token NOT IN ({_words(RESERVED[language] + LITERALS)}))"
            for language, pattern in NAME_PATTERNS.items()
        },
        "false",
    )


_FILE = "PARTITION BY doc_id ORDER BY pos"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_OPENS, _CLOSES = "('(', '[', '{')", "(')', ']', '}')"
_TYPE_WORD = _by_language({"C++": f"token IN ({_words(CPP_TYPES)})", "C#": f"token IN ({_words(CSHARP_TYPES)})"}, "false")
# Tokens that a type may be made of.
_TYPE_MARKS = "('<', '>', '*', '&', '&&', '::', '.', '?', '[', ']', ',', 'const', 'static', 'readonly', 'public', 'private', 'protected', 'internal', 'constexpr', 'unsigned', 'ref', 'out')"
_GO_TYPE = f"(a1_name OR a1 IN ({_words(GO_TYPE_STARTS)}) OR (a1 = '[' AND a2 = ']'))"
_STARTS_LINE = "(first_before IS NULL OR first_before IN (chr(10), ';', '{', '('))"

# Neighbours, depths, statements (lines in Python).
_STEP_NEAR = [
    *[(f"b{n}", f"lag(token, {n}) OVER ({_FILE})") for n in (1, 2, 3)],
    *[(f"a{n}", f"lead(token, {n}) OVER ({_FILE})") for n in (1, 2, 3)],
    *[(f"b{n}_name", f"coalesce(lag(is_name, {n}) OVER ({_FILE}), false)") for n in (1, 2)],
    *[(f"b{n}_type", f"coalesce(lag(is_type, {n}) OVER ({_FILE}), false)") for n in (1, 2)],
    ("a1_name", f"coalesce(lead(is_name, 1) OVER ({_FILE}), false)"),
    ("depth", f"sum(CASE WHEN token IN {_OPENS} THEN 1 WHEN token IN {_CLOSES} THEN -1 ELSE 0 END) OVER ({_FILE})"),
    ("braces", f"sum(CASE WHEN token = '{{' THEN 1 WHEN token = '}}' THEN -1 ELSE 0 END) OVER ({_FILE})"),
    (
        "part",
        "coalesce(sum(CASE WHEN (language IN ('C++', 'C#') AND token IN (';', '{', '}')) "
        f"OR (language = 'Python' AND token IN (chr(10), ';')) THEN 1 ELSE 0 END) OVER ({_FILE} {_BEFORE}), 0)",
    ),
    (
        "header",
        f"max(CASE WHEN language = 'Python' AND token IN ('def', 'lambda') THEN pos END) OVER ({_FILE})",
    ),
]

# What the bracket around a token is for: 0 anything, 1 parameters, 2 a block of declarations, 3 a group of names.
_KIND = _by_language(
    {
        "C++": "CASE WHEN b1 IN ('catch', 'for') OR (b1_name AND (b2_type OR b2_name OR b2 IN ('void', '*', '&', '>'))) THEN 1 ELSE 0 END",
        "C#": "CASE WHEN b1 IN ('catch', 'using', 'fixed') OR (b1_name AND (b2_type OR b2_name OR b2 IN ('void', '>', ']', '?'))) THEN 1 ELSE 0 END",
        "Go": "CASE WHEN b1 IN ('var', 'const') THEN 2 WHEN b1 = 'func' OR (b1_name AND b2 IN ('func', ')')) THEN 1 ELSE 0 END",
        "Python": "CASE WHEN b1_name OR b1 IN (')', ']', 'STRING_LITERAL') THEN 0 ELSE 3 END",
    },
    "0",
)
_STEP_PLACE = [
    (
        "around",
        f"coalesce(max(CASE WHEN token IN ('(', '[') THEN CAST(pos AS BIGINT) * 4 + {_KIND} END) OVER (PARTITION BY doc_id, depth ORDER BY pos) % 4, 0)",
    ),
    ("ends", "last_value(token) OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("starts", "first_value(token) OVER (PARTITION BY doc_id, part ORDER BY pos)"),
    ("base", "first_value(depth) OVER (PARTITION BY doc_id, part ORDER BY pos)"),
    (
        "impure",
        "coalesce(sum(CASE WHEN is_name OR is_type OR token IN "
        f"{_TYPE_MARKS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, part ORDER BY pos {_BEFORE}), 0)",
    ),
    ("angled", f"coalesce(max(CASE WHEN token = '<' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY pos {_BEFORE}), 0)"),
    # Python: the first assignment of the line, and of a header the end of its parameters.
    (
        "assigned",
        f"coalesce(max(CASE WHEN token IN ({_words(PYTHON_ASSIGNMENTS)}) AND language = 'Python' THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY doc_id, part, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
    ),
    (
        "assigns",
        "max(CASE WHEN token = '=' AND language = 'Python' THEN CAST(pos AS BIGINT) * 1000000 + depth END) "
        "OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ),
    ("opened", "CASE WHEN header IS NOT NULL THEN first_value(depth) OVER (PARTITION BY doc_id, header ORDER BY pos) END"),
    ("opener", "CASE WHEN header IS NOT NULL THEN first_value(token) OVER (PARTITION BY doc_id, header ORDER BY pos) END"),
    # Go: a name that can stand in a list of names, not in a type.
    ("member", "coalesce(language = 'Go' AND is_name AND NOT b1_name AND coalesce(b1 NOT IN ('.', '*', ']', 'chan', 'map', '...', '<-'), true), false)"),
]
_STEP_HEADS = [
    ("lowest", "min(CASE WHEN header IS NOT NULL AND pos >= header + 2 THEN depth END) OVER (PARTITION BY doc_id, header ORDER BY pos)"),
    ("lowest_all", "min(depth) OVER (PARTITION BY doc_id, header ORDER BY pos)"),
    (
        "over",
        "max(CASE WHEN token = ':' AND pos > header AND depth = opened THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, header ORDER BY pos)",
    ),
    # The first name of each list: no name and comma before it.
    ("leads", f"member AND NOT (coalesce(b1 = ',', false) AND coalesce(lag(member, 2) OVER ({_FILE}), false))"),
]
_TYPED = (
    "(b1_type OR b1_name OR (b1 IN ('*', '&', '&&') AND (b2_type OR b2_name OR b2 = '>') AND (impure = 0 OR around = 1)) "
    "OR (b1 IN (']', '?') AND (b2_type OR b2_name OR b2 = '[')) OR (b1 = '>' AND angled = 1 AND (impure = 0 OR around = 1)))"
)
_STEP_RUNS = [
    ("list", f"sum(CASE WHEN leads THEN 1 ELSE 0 END) OVER ({_FILE})"),
    (
        "typed",
        _by_language(
            {
                "C++": f"is_name AND coalesce({_TYPED}, false) AND coalesce(a1 IN ('=', ';', '[') OR (depth = braces AND (a1 = ',' "
                "OR (a1 = '(' AND ends = ';') OR (a1 = '{' AND a2 <> chr(10)))), false)",
                "C#": f"is_name AND coalesce({_TYPED}, false) AND coalesce(a1 IN ('=', ';', ',', ')'), false)",
            },
            "false",
        ),
    ),
]
_STEP_LISTS = [
    ("first_before", "first_value(b1) OVER (PARTITION BY doc_id, list ORDER BY pos)"),
    (
        "last_typed",
        f"max(CASE WHEN member AND coalesce({_GO_TYPE}, false) THEN 1 WHEN member AND a1 = '*' THEN 2 WHEN member AND a1 = ':=' AND coalesce(a2 <> 'range', true) THEN 3 "
        "WHEN member AND a1 = ',' THEN 0 ELSE -1 END) OVER (PARTITION BY doc_id, list, chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ),
    (
        "stated",
        f"coalesce(max(CASE WHEN typed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part, depth ORDER BY pos {_BEFORE}), 0)",
    ),
]
# Names and commas that follow each other from the first name on.
_STEP_CHAINS = [
    (
        "chain",
        "CASE WHEN member OR (token = ',' AND language = 'Go') THEN sum(CASE WHEN member OR token = ',' THEN 0 ELSE 1 END) "
        "OVER (PARTITION BY doc_id, list ORDER BY pos) END",
    ),
]
_GO = (
    "member AND (coalesce(first_before IN ('var', 'const'), false) "
    "OR (last_typed = 3 AND coalesce(first_before <> 'case', true)) "
    "OR (around = 2 AND coalesce(first_before IN ('(', chr(10), ';'), false)) "
    "OR (last_typed = 1 AND coalesce(first_before IN ('(', ',', '{', ';', chr(10)), false)) "
    "OR (last_typed = 2 AND (coalesce(first_before IN ('{', ';', chr(10)), false) "
    "OR (around = 1 AND coalesce(first_before IN ('(', ','), false)))))"
)
_LISTED = "is_name AND depth = braces AND stated = 1 AND coalesce(b1 = ',' AND a1 IN (',', ';', '=', '[', '(', '{'), false)"
_PY_STARTS = f"(b1 IS NULL OR b1 IN (chr(10), ';', '=', '.') OR (b1 = ':' AND b2 IN ({_words(PYTHON_CLAUSE_ENDS)})))"
_PYTHON = (
    "is_name AND ("
    f"coalesce({_PY_STARTS} AND a1 IN ({_words(PYTHON_ASSIGNMENTS)}), false) "
    # Names of a tuple or list before the line's assignment.
    "OR coalesce(assigns > CAST(pos AS BIGINT) * 1000000 AND assigns % 1000000 = line_depth AND assigned = 0 AND (depth = line_depth OR around = 3) "
    "AND starts NOT IN ('def', 'class', 'lambda', 'for', 'if', 'while', 'with', 'return', 'import', 'from', 'assert', 'elif', 'del') "
    "AND (b1 IS NULL OR b1 IN (chr(10), ';', ',', '(', '[', '*', '.')) AND a1 IN (',', ')', ']', '='), false) "
    "OR coalesce(a1 = ':' AND a3 = '=' AND (b1 IS NULL OR b1 IN (chr(10), ';')), false) "
    "OR coalesce(b1 = 'as' AND a1 = ':' AND coalesce(b3 <> 'except', true), false) "
    "OR coalesce(b1 = 'as' AND a1 = ',' AND starts IN ('with', 'async'), false) "
    "OR coalesce(b1 = 'case' AND a1 IN (':', 'if'), false) "
    "OR coalesce(opener = 'def' AND pos - header >= 3 AND depth = opened + 1 AND b1 IN ('(', ',', '*', '**') AND lowest > opened, false) "
    "OR coalesce(opener = 'lambda' AND pos > header AND depth = opened AND b1 IN ('lambda', ',', '*', '**') "
    "AND lowest_all >= opened AND over = 0, false))"
)
_STEP_DECLARES = [
    (
        "declares",
        "coalesce(" + _by_language({"C++": f"typed OR ({_LISTED})", "C#": f"typed OR ({_LISTED})", "Go": _GO, "Python": _PYTHON}, "false") + ", false)",
    ),
    # A closing brace belongs to the level it closes.
    ("level", "CASE WHEN token = '}' THEN braces + 1 ELSE braces END"),
]
# Read backwards: a frame that runs to the end of a file would be summed up anew for each row.
_STEP_SCOPES = [
    (
        "scope_end",
        "CASE WHEN language = 'Python' THEN NULL ELSE min(CASE WHEN token = '}' THEN pos END) "
        "OVER (PARTITION BY doc_id, level ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END",
    ),
]
_STEP_MASKS = [
    (
        "hidden",
        "coalesce(max(CASE WHEN declares THEN coalesce(scope_end, 2147483647) END) OVER (PARTITION BY doc_id, token ORDER BY pos) > pos, false)",
    ),
]


def steps(matches) -> list[list[tuple[str, str]]]:
    """All steps from `doc_id`, `language`, `pos`, `token` to `hidden`."""
    named = [("is_name", f"coalesce({name_test(matches)}, false)"), ("is_type", f"coalesce({_TYPE_WORD}, false)")]
    line = [
        ("line_depth", "CASE WHEN starts IN ('(', '[', '{') THEN base - 1 ELSE base END"),
    ]
    return [
        named, _STEP_NEAR, _STEP_PLACE, line + _STEP_HEADS, _STEP_RUNS, _STEP_CHAINS, _STEP_LISTS,
        _STEP_DECLARES, _STEP_SCOPES, _STEP_MASKS,
    ]


def masked_sql(tokens: str, matches) -> str:
    """The steps as nested SQL over a table of tokens, giving `hidden`."""
    for step in steps(matches):
        tokens = f"(SELECT *, {', '.join(f'{expression} AS {name}' for name, expression in step)} FROM {tokens})"
    return tokens
