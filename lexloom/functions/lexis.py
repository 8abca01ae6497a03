"""Source text to normalised tokens, as column expressions.

Every tokeniser is one `regexp_extract_all` over the whole text followed by
array functions, so a corpus is tokenised inside the scan stage without a
shuffle; only the logical lines of Python are settled in Arrow batches. Quantifiers
are possessive wherever a literal or a comment may be long: the JVM matches those in
a loop, while nested greedy groups recurse and overflow the stack on large files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_LITERAL = "STRING_LITERAL"
INT_LITERAL = "INT_LITERAL"
FLOAT_LITERAL = "FLOAT_LITERAL"
BOOL_LITERAL = "BOOL_LITERAL"
VARIABLE = "VARIABLE"
NEWLINE = "\n"

# What the generic tokeniser replaces, in this order, and finds.
GENERIC_REPLACEMENTS = [
    (r"'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'", f" {STRING_LITERAL} "),
    (r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"', f" {STRING_LITERAL} "),
    (r"0x[\p{L}\p{N}_]++", f" {INT_LITERAL} "),
    (r"\p{Nd}++", f" {INT_LITERAL} "),
]
GENERIC_TOKEN = (
    r"[\p{L}\p{N}_]++|\.|[<>/\\{}\[\]()'\"]"
    r"|[^a-zA-Z0-9_ \t\n.<>/\\{}\[\]()'\"]++"
)

# The FAST patterns find the same tokens as those they end in. They first try what
# most tokens are: names of ASCII letters, and marks that begin no longer token.
_GENERIC_FAST_TOKEN = r"[a-z0-9_]++[\p{L}\p{N}_]*+|" + GENERIC_TOKEN


def greedy(pattern: str) -> str:
    """The same pattern without possessive marks, for engines that lack them."""
    return re.sub(r"(?<!\\)([*+?}])\+", r"\1", pattern)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and let `body` refer to it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str, blanks: str = r" \t") -> Column:
    """All matches of `pattern`, none of which may begin with one of `blanks`.

    A run of blanks is passed over at its first character, so that the alternatives
    are not tried at each one, nor the run read again where nothing follows it.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?:(?<![{blanks}])[{blanks}]++)?({pattern})"), F.lit(1))


def replace_all(text: Column, replacements: list[tuple[str, str]]) -> Column:
    for pattern, replacement in replacements:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def generic_tokens(text: Column) -> Column:
    """Lower-case, fold literals to class tokens, split."""
    return find_all(replace_all(F.lower(text), GENERIC_REPLACEMENTS), _GENERIC_FAST_TOKEN, r" \t\n")


# --- C++ ---------------------------------------------------------------------

_BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_LINE_COMMENT = r"//[^\r\n]*+"

_CPP_DIGITS = r"[0-9](?:'?[0-9])*+"
_CPP_FRACTION = rf"(?:{_CPP_DIGITS})?\.{_CPP_DIGITS}|{_CPP_DIGITS}\."
_CPP_EXPONENT = rf"[eE][+-]?{_CPP_DIGITS}"
_CPP_FLOAT = rf"(?:{_CPP_FRACTION})(?:{_CPP_EXPONENT})?|{_CPP_DIGITS}{_CPP_EXPONENT}"
_CPP_INTEGER = (
    r"0[xX][0-9a-fA-F](?:'?[0-9a-fA-F])*+|0[bB][01](?:'?[01])*+"
    r"|[1-9](?:'?[0-9])*+|0(?:'?[0-7])*+"
)
_CPP_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"

CPP_TOKEN = "|".join(
    [
        _LINE_COMMENT,
        _BLOCK_COMMENT,
        r"#[^\\\n]*+(?:\\(?:\r?\n)?+[^\\\n]*+)*+",
        rf'(?:u8|u|U|L)?R"[^\r\n (]*+\([^)]*+\)[^\r\n "]*+"(?:{_CPP_NAME})?',
        rf'(?:u8|u|U|L)?"[^"\\\r\n]*+(?:\\(?:\r\n|[^\r]|\r)[^"\\\r\n]*+)*+"(?:{_CPP_NAME})?',
        rf"[uUL]?'(?:[^'\\\r\n]|\\(?:\r\n|[^\r]|\r))++'(?:{_CPP_NAME})?",
        rf"(?:{_CPP_FLOAT})(?:{_CPP_NAME})?",
        rf"(?:{_CPP_INTEGER})(?:{_CPP_NAME})?",
        _CPP_NAME,
        r"<<=|>>=|->\*|\.\.\.|\+\+|--|->|::|\.\*|&&|\|\|",
        r"\+=|-=|\*=|/=|%=|\^=|&=|\|=|==|!=|<=|>=",
        r"[(){}\[\],.:;<>=!?&|^~%*/+-]",
    ]
)
_CPP_FAST_TOKEN = r"[A-Za-z_&&[^uULR]][A-Za-z0-9_]*+|[(){}\[\],;?~]|" + CPP_TOKEN
CPP_INTEGER_LITERAL = (
    rf"^(?:{_CPP_INTEGER})(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?$"
)
CPP_FLOAT_LITERAL = rf"^(?:{_CPP_FLOAT})[flFL]?$"
NUMBER_START = r"^\.?[0-9]"


# Token tests compare bytes in place; a regex or a substring per token would
# cost more than finding the token did.


def _is_quoted(token: Column) -> Column:
    return token.endswith('"') | token.endswith("'")


def _is_number(token: Column) -> Column:
    return token.between("0", "9\U0010ffff") | token.between(".0", ".9\U0010ffff")


def _starts(token: Column, *starts: str) -> Column:
    tests = [token.startswith(start) for start in starts]
    either = tests[0]
    for test in tests[1:]:
        either = either | test
    return either


def cpp_tokens(text: Column) -> Column:
    """C++: comments and preprocessor lines dropped, literals folded.

    A literal with a user-defined suffix stays as it is.
    """

    def kept(t):
        return ~_starts(t, "//", "/*", "#")

    def folded(t):
        return (
            F.when(_is_quoted(t), STRING_LITERAL)
            .when(t.isin("true", "false"), BOOL_LITERAL)
            .when(
                _is_number(t),
                F.when(t.rlike(CPP_INTEGER_LITERAL), INT_LITERAL)
                .when(t.rlike(CPP_FLOAT_LITERAL), FLOAT_LITERAL)
                .otherwise(t),
            )
            .otherwise(t)
        )

    return F.transform(F.filter(find_all(text, _CPP_FAST_TOKEN, r" \t\r\n"), kept), folded)


# --- C# ----------------------------------------------------------------------

_CS_NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}]*+"
_CS_DIGITS = r"[0-9](?:_*[0-9])*+"
_CS_EXPONENT = rf"[eE][+-]?{_CS_DIGITS}"
_CS_SUFFIX = r"(?:[lL][uU]|[uU][lL]|[uU]|[lL])?"
_CS_NOT_LINE_END = r"[^\r\n\x{0085}\x{2028}\x{2029}]"
_CS_REAL = (
    rf"(?:{_CS_DIGITS})?\.{_CS_DIGITS}(?:{_CS_EXPONENT})?[FfDdMm]?"
    rf"|{_CS_DIGITS}(?:[FfDdMm]|{_CS_EXPONENT}[FfDdMm]?)"
)

CSHARP_TOKEN = "|".join(
    [
        rf"//{_CS_NOT_LINE_END}*+",
        _BLOCK_COMMENT,
        rf"#{_CS_NOT_LINE_END}*+",
        r'\$@"(?:""|\{\{|\{[^"{}]*+\}|[^"{])*+"',
        r'\$"[^"\\{]*+(?:(?:\\[^\n]|\{\{|\{[^"{}]*+(?:"[^"\\\r\n]*+"[^"{}]*+)*+\})[^"\\{]*+)*+"',
        r'@"[^"]*+(?:""[^"]*+)*+"',
        r'"[^"\\\r\n]*+(?:\\[^\r\n][^"\\\r\n]*+)*+"',
        r"'(?:[^'\\\r\n]|\\[^\r\n][0-9a-fA-F]{0,8})'",
        rf"{_CS_DIGITS}{_CS_SUFFIX}\.@?{_CS_NAME}",
        _CS_REAL,
        rf"0[xX](?:_*[0-9a-fA-F])++{_CS_SUFFIX}",
        rf"0[bB](?:_*[01])++{_CS_SUFFIX}",
        rf"{_CS_DIGITS}{_CS_SUFFIX}",
        rf"@?{_CS_NAME}",
        r"\?\?=|<<=|\?\?|\+\+|--|&&|\|\||->|<<|::|\.\.",
        r"\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=",
        r"[(){}\[\],.:;<>=!?&|^~%*/+-]",
    ]
)
_CSHARP_FAST_TOKEN = (
    r"[A-Za-z_][A-Za-z0-9_]*+[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}]*+|[(){}\[\],;~]|" + CSHARP_TOKEN
)
CSHARP_REAL_LITERAL = rf"^(?:{_CS_REAL})$"
CSHARP_ACCESS = rf"^{_CS_DIGITS}{_CS_SUFFIX}\.@?{_CS_NAME}$"


def csharp_tokens(text: Column) -> Column:
    """C#: an interpolated string is one literal; `0.Name` stays as it is."""

    def kept(t):
        return ~_starts(t, "//", "/*", "#")

    def folded(t):
        return (
            F.when(_is_quoted(t), STRING_LITERAL)
            .when(t.isin("true", "false"), BOOL_LITERAL)
            .when(
                _is_number(t),
                F.when(t.rlike(CSHARP_ACCESS), t)
                .when(t.rlike(CSHARP_REAL_LITERAL), FLOAT_LITERAL)
                .otherwise(INT_LITERAL),
            )
            .otherwise(t)
        )

    return F.transform(F.filter(find_all(text, _CSHARP_FAST_TOKEN, r" \t\r\n"), kept), folded)


# --- Go ----------------------------------------------------------------------

_GO_DIGITS = r"[0-9](?:_?[0-9])*+"
_GO_EXPONENT = rf"[eE][+-]?{_GO_DIGITS}"
_GO_FLOAT = (
    r"0[xX](?:(?:_?[0-9a-fA-F])++(?:\.(?:_?[0-9a-fA-F])*+)?|\.[0-9a-fA-F](?:_?[0-9a-fA-F])*+)"
    rf"[pP][+-]?{_GO_DIGITS}"
    rf"|{_GO_DIGITS}(?:\.(?:{_GO_DIGITS})?(?:{_GO_EXPONENT})?|{_GO_EXPONENT})"
    rf"|\.{_GO_DIGITS}(?:{_GO_EXPONENT})?"
)
_GO_INTEGER = (
    r"0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO]?(?:_?[0-7])++"
    r"|[1-9](?:_?[0-9])*+|0"
)
_GO_NAME = r"[\p{L}_][\p{L}\p{Nd}_]*+"

GO_TOKEN = "|".join(
    [
        _LINE_COMMENT,
        _BLOCK_COMMENT,
        r"`[^`]*+`",
        r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"',
        r"'(?:\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abfnrtv\\'\"])|[^\r\n'])'",
        rf"(?:{_GO_FLOAT})i?",
        rf"(?:{_GO_INTEGER})i?",
        _GO_NAME,
        r"[\r\n]++",
        r"\.\.\.|\+\+|--|:=|\|\||&&|==|!=|<=|>=|<<|>>|&\^|<-",
        r"[(){}\[\],.:;<>=!&|^%*/+-]",
    ]
)
_GO_FAST_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*+[\p{L}\p{Nd}_]*+|[(){}\[\],;]|" + GO_TOKEN
GO_FLOAT_LITERAL = rf"^(?:{_GO_FLOAT})$"
# A line end closes the statement only after one of these, or
# after a name or a literal.
GO_OPEN_KEYWORDS = [
    "default", "func", "interface", "select", "case", "defer", "go", "map",
    "struct", "chan", "else", "goto", "package", "switch", "const", "if",
    "range", "type", "for", "import", "var",
]
GO_CLOSING_MARKS = [")", "}", "]", "++", "--"]


def go_closes_statement(t: Column) -> Column:
    return t.isin(GO_CLOSING_MARKS) | (
        t.rlike(r"^[\p{L}_]") & ~t.isin(GO_OPEN_KEYWORDS)
    )


def go_tokens(text: Column) -> Column:
    """Go: runes and imaginary numbers are integers; a statement end is a token."""

    def is_break(t):
        return _starts(t, "\r", "\n") | (t.startswith("/*") & t.rlike(r"[\r\n]"))

    def kept(t):
        return ~_starts(t, "//", "/*") | is_break(t)

    def folded(t):
        return (
            F.when(is_break(t), NEWLINE)
            .when(_starts(t, '"', "`"), STRING_LITERAL)
            .when(t.startswith("'"), INT_LITERAL)
            .when(
                _is_number(t),
                F.when(t.rlike(GO_FLOAT_LITERAL), FLOAT_LITERAL).otherwise(INT_LITERAL),
            )
            .otherwise(t)
        )

    def statement_ends(tokens):
        return F.filter(
            tokens,
            lambda t, i: (t != NEWLINE)
            | F.coalesce(go_closes_statement(F.get(tokens, i - 1)), F.lit(False)),
        )

    folded_tokens = F.transform(F.filter(find_all(text, _GO_FAST_TOKEN), kept), folded)
    return bind(folded_tokens, statement_ends)


# --- Python ------------------------------------------------------------------

_PY_NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*+"
_PY_PREFIX = r"(?:[fF][rR]|[rR][fF]|[bB][rR]|[rR][bB]|[rRuUfFbB])?"
_PY_NUMBER = "|".join(
    [
        r"0[oO][0-7]++",
        r"0[xX][0-9a-fA-F]++",
        r"0[bB][01]++",
        r"(?:[0-9]*\.[0-9]++|[0-9]++\.)(?:[eE][+-]?[0-9]++)?[jJ]?",
        r"[0-9]++[eE][+-]?[0-9]++[jJ]?",
        r"[0-9]++[jJ]",
        r"[1-9][0-9]*+",
        r"0++",
    ]
)


def _py_long_string(quote: str) -> str:
    other = rf"[^{quote}\\]"
    return (
        rf"{quote}{{3}}{other}*+"
        rf"(?:(?:\\[\s\S]|{quote}{{1,2}}(?:{other}|\\[\s\S])){other}*+)*+{quote}{{3}}"
    )


def _py_short_string(quote: str) -> str:
    other = rf"[^{quote}\\\r\n\f]"
    return rf"{quote}{other}*+(?:\\(?:\r\n|[\s\S]){other}*+)*+{quote}"


PYTHON_TOKEN = "|".join(
    [
        r"#[^\r\n\f]*+",
        r"\\[ \t]*+(?:\r?\n|\r|\f)",
        rf"{_PY_PREFIX}(?:"
        + "|".join(
            [
                _py_long_string("'"),
                _py_long_string('"'),
                _py_short_string("'"),
                _py_short_string('"'),
            ]
        )
        + ")",
        _PY_NUMBER,
        _PY_NAME,
        r"\r?\n|\r|\f",
        r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|<>|->",
        r"\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=",
        r"[^ \t\r\n\f]",
    ]
)


# Names that may begin a string are taken as names unless a quote follows them.
_PYTHON_FAST_TOKEN = "|".join(
    [
        r"[a-zA-Z_&&[^fFrRbBuU]][A-Za-z0-9_]*+[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*+",
        r"[(){},:;~\[\]]",
        r"[a-zA-Z_][A-Za-z0-9_]*+(?![\"'\P{ASCII}])",
        r"=(?!=)",
        r"\r?\n",
        PYTHON_TOKEN,
    ]
)

_PY_BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def _python_folded(token: str) -> str | None:
    """A token as its class; None for comments and joined lines."""
    first = token[:1]
    if first == "#" or (first == "\\" and token != "\\"):
        return None
    if token[-1:] in ("'", '"') and (len(token) > 1):
        return STRING_LITERAL
    if token in ("True", "False"):
        return BOOL_LITERAL
    if "0" <= first <= "9" or (first == "." and "0" <= token[1:2] <= "9"):
        return FLOAT_LITERAL
    return NEWLINE if first in ("\r", "\n", "\f") else token


def _logical_lines(found: pa.Array) -> pa.Array:
    """Token lists folded, with the line ends that no bracket encloses, one of each run.

    Tokens are folded once for each different one of a batch; brackets are counted
    by running sums.
    """
    lengths = found.value_lengths().fill_null(0).to_numpy()
    coded = found.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    folded = [_python_folded(word) for word in words]
    code = coded.indices.to_numpy()
    kept = np.array([text is not None for text in folded], bool)[code]
    code, file = code[kept], np.repeat(np.arange(len(lengths)), lengths)[kept]
    line_end = np.array([text == NEWLINE for text in folded], bool)[code]
    step = np.array([_PY_BRACKETS.get(word, 0) for word in words], np.int64)[code]
    first = np.append(True, file[1:] != file[:-1])[: len(file)]
    # Brackets opened before a token, less those opened before its file.
    before = np.cumsum(step) - step
    before -= before[first][np.cumsum(first) - 1]
    repeated = np.append(False, line_end[:-1])[: len(file)] & ~first
    shown = ~line_end | (~repeated & (before <= 0))
    tokens = pa.array(folded, pa.string()).take(pa.array(code[shown]))
    counts = np.bincount(file[shown], minlength=len(lengths))
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, tokens, mask=found.is_null())


def python_tokens(text: Column) -> Column:
    """Python: one line-end token per logical line, every number one class."""
    settled = F.arrow_udf(_logical_lines, "array<string>")
    return settled(find_all(text, _PYTHON_FAST_TOKEN))


# --- dispatch ----------------------------------------------------------------

TOKENISERS: dict[str, Callable[[Column], Column]] = {
    "C++": cpp_tokens,
    "C#": csharp_tokens,
    "Go": go_tokens,
    "Python": python_tokens,
}


def tokens_by_language(
    language: Column, text: Column, ignored: list[str] | None = None
) -> Column:
    """Tokens of a file; NULL where the language is NULL or ignored."""
    chosen = F.when(language.isNull(), None)
    if ignored:
        chosen = chosen.when(language.isin(ignored), None)
    for name, tokenise in TOKENISERS.items():
        # Batches of one language hold no text of another.
        chosen = chosen.when(language == name, tokenise(F.when(language == name, text)))
    return chosen.otherwise(generic_tokens(text))
