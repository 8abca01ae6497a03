"""Masking of declared names as VARIABLE.

Files are masked inside the scan: a batch of token lists becomes arrays of small
numbers, one per word, and every rule is a pass over these arrays. Declarations
are found from neighbouring tokens, from the statement or line a token stands in,
and from the bracket around it. A name is masked from its declaration to the
brace that closes the block it was declared in; Python names to the end of the
file. Nothing is exploded or shuffled. A list is masked by itself, however many
rows share an id; null lists and lists of other languages stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.functions.lexis import VARIABLE
from lexloom.schema import KEYWORD_SETS

# Built-in type words of each language.
CPP_TYPES = [
    "auto", "bool", "char", "char16_t", "char32_t", "double", "float", "int",
    "long", "short", "signed", "unsigned", "wchar_t",
]
CSHARP_TYPES = [
    "bool", "byte", "char", "decimal", "double", "dynamic", "float", "int",
    "long", "object", "sbyte", "short", "string", "uint", "ulong", "ushort",
    "var",
]
GO_TYPE_STARTS = ["map", "chan", "func", "interface", "struct", "..."]

# Reserved words that are not types.
CPP_WORDS = sorted(
    set(KEYWORD_SETS["C++"])
    - {"bool"}
    | {"and", "case", "const", "constexpr", "default", "noexcept", "not", "or", "override", "void"}
)
CSHARP_WORDS = sorted(
    set(KEYWORD_SETS["C++"])
    - {"bool"}
    | {
        "abstract", "as", "await", "base", "case", "checked", "const", "default",
        "event", "fixed", "foreach", "in", "interface", "internal", "is", "lock",
        "null", "out", "override", "params", "readonly", "ref", "sealed", "void",
        "when", "where", "yield",
    }
)
GO_WORDS = KEYWORD_SETS["Go"]
PYTHON_WORDS = KEYWORD_SETS["Python"] + ["elif", "match", "case", "_"]

# What makes the name before it an assignment target.
PYTHON_ASSIGNMENTS = [
    "=", "+=", "-=", "*=", "@=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=",
    "**=", "//=",
]

# Tokens before a colon that opens a clause on the same line.
PYTHON_CLAUSE_ENDS = [")", "else", "finally", "try"]

LITERALS = ["STRING_LITERAL", "INT_LITERAL", "FLOAT_LITERAL", "BOOL_LITERAL"]

ASCII_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
UNICODE_NAME = r"^@?[\p{L}\p{Nl}_]"

RESERVED = {
    "C++": CPP_WORDS + CPP_TYPES,
    "C#": CSHARP_WORDS + CSHARP_TYPES,
    "Go": GO_WORDS,
    "Python": PYTHON_WORDS,
}

# Tokens masked at once; a longer file is masked alone.
CHUNK_TOKENS = 500_000

# Tokens a type may be made of.
TYPE_MARKS = [
    "<", ">", "*", "&", "&&", "::", ".", "?", "[", "]", ",", "const", "static", "readonly", "public", "private",
    "protected", "internal", "constexpr", "unsigned", "ref", "out",
]

# --- words as numbers --------------------------------------------------------

_LANGUAGES = ["C++", "C#", "Go", "Python"]
_CPP, _CSHARP, _GO, _PYTHON = range(4)
_OTHER = 4

# Words that a rule names have a number; all others are 0, and -1 stands beyond the ends of a file.
_NUMBERS: dict[str, int] = {}
_MANY = 1 << 10


def _one(word: str) -> int:
    return _NUMBERS.setdefault(word, len(_NUMBERS) + 1)


def _any(*words: str) -> np.ndarray:
    """Table to look up by number whether a word is among `words`."""
    table = np.zeros(_MANY, bool)
    table[[_one(word) for word in words]] = True
    return table


_COMMA, _COLON, _ASSIGN, _STAR, _ANGLE, _BRACE = map(_one, [",", ":", "=", "*", "<", "}"])
_LINE, _CALL, _BLOCK, _SHORT, _RANGE, _CASE, _AS = map(_one, ["\n", "(", "{", ":=", "range", "case", "as"])
_DEF, _LAMBDA, _EXCEPT, _SEMICOLON, _SQUARE, _END = map(_one, ["def", "lambda", "except", ";", "]", ")"])
_STEPS = np.zeros(_MANY, np.int64)
_BRACES = np.zeros(_MANY, np.int64)
for _word, _step in {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.items():
    _STEPS[_one(_word)] = _step
    _BRACES[_one(_word)] = _step * (_word in "{}")
_ENDS_PART = np.zeros((_OTHER + 1, _MANY), bool)
_ENDS_PART[_CPP] = _ENDS_PART[_CSHARP] = _any(";", "{", "}")
_ENDS_PART[_PYTHON] = _any("\n", ";")
_IS_RESERVED = np.stack([_any(*RESERVED[name], *LITERALS) for name in _LANGUAGES] + [np.ones(_MANY, bool)])
_IS_TYPE = np.zeros((_OTHER + 1, _MANY), bool)
_IS_TYPE[_CPP], _IS_TYPE[_CSHARP] = _any(*CPP_TYPES), _any(*CSHARP_TYPES)
_IS_MARK, _IS_ASSIGNMENT = _any(*TYPE_MARKS), _any(*PYTHON_ASSIGNMENTS)
_OPENS_GROUP, _OPENS_ANY = _any("(", "["), _any("(", "[", "{")
_IS_GO_TYPE = _any(*GO_TYPE_STARTS)

# Words that a rule asks for beside a name, a bracket or a statement.
_CPP_HEADS = _any("catch", "for")
_CPP_RESULTS = _any("void", "*", "&", ">")
_CSHARP_HEADS = _any("catch", "using", "fixed")
_CSHARP_RESULTS = _any("void", ">", "]", "?")
_FUNC = _any("func")
_FUNC_OR_RECEIVER = _any("func", ")")
_GO_DECLARES = _any("var", "const")
_VALUE_ENDS = _any(")", "]", "STRING_LITERAL")
_POINTERS = _any("*", "&", "&&")
_CLOSED_ANGLE = _any(">")
_SUFFIXES = _any("]", "?")
_SQUARE_OPEN = _any("[")
_CPP_AFTER = _any("=", ";", "[")
_CSHARP_AFTER = _any("=", ";", ",", ")")
_LIST_AFTER = _any(",", ";", "=", "[", "(", "{")
_GO_NOT_BEFORE = _any(".", "*", "]", "chan", "map", "...", "<-")
_GROUP_STARTS = _any("(", "\n", ";")
_TYPED_STARTS = _any("(", ",", "{", ";", "\n")
_STATEMENT_STARTS = _any("{", ";", "\n")
_PARAMETER_STARTS = _any("(", ",")
_LINE_ENDS = _any("\n", ";")
_TARGET_BEFORE = _any("=", ".")
_CLAUSE_ENDS = _any(*PYTHON_CLAUSE_ENDS)
_TUPLE_BEFORE = _any("\n", ";", ",", "(", "[", "*", ".")
_TUPLE_AFTER = _any(",", ")", "]", "=")
_DEF_BEFORE = _any("(", ",", "*", "**")
_LAMBDA_BEFORE = _any("lambda", ",", "*", "**")
_WITH = _any("with", "async")
_CASE_AFTER = _any(":", "if")
_PYTHON_HEADS = _any("def", "class", "lambda", "for", "if", "while", "with", "return", "import", "from", "assert", "elif", "del")

_FULL_NAME = re.compile(ASCII_NAME.rstrip("$"))


def _ascii_name(word: str) -> bool:
    return _FULL_NAME.fullmatch(word) is not None


def _unicode_name(word: str) -> bool:
    """Whether a word begins like UNICODE_NAME."""
    first = word[1:2] if word[:1] == "@" else word[:1]
    return first == "_" or (first != "" and unicodedata.category(first)[:2] in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl"))


# --- passes over rows in order -----------------------------------------------


class _Runs:
    """Rows in runs: contiguous ones that begin at `first`, or those of equal `key`, in order."""

    def __init__(self, first: np.ndarray | None = None, key: np.ndarray | None = None):
        self.order = None
        if first is None:
            self.order = np.argsort(key, kind="stable")
            ordered = key[self.order]
            first = np.append(True, ordered[1:] != ordered[:-1])
        self.first = first
        self.begin = np.flatnonzero(first)
        self.number = np.cumsum(first) - 1

    def _in(self, values: np.ndarray) -> np.ndarray:
        return values if self.order is None else values[self.order]

    def _out(self, values: np.ndarray) -> np.ndarray:
        if self.order is None:
            return values
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def _largest(self, values: np.ndarray) -> np.ndarray:
        least = int(values.min())
        # Each run lies above the one before it.
        raised = self.number * (int(values.max()) - least + 1)
        return np.maximum.accumulate(values + raised) - raised

    def largest(self, values: np.ndarray) -> np.ndarray:
        """The largest value of the run so far."""
        return self._out(self._largest(self._in(values).astype(np.int64)))

    def before(self, flags: np.ndarray) -> np.ndarray:
        """Whether an earlier row of the run has the flag."""
        so_far = self._largest(self._in(flags).astype(np.int64))
        earlier = np.append(0, so_far[:-1])
        earlier[self.first] = 0
        return self._out(earlier > 0)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The running sum."""
        sums = np.cumsum(self._in(values))
        base = sums[self.begin] - self._in(values)[self.begin]
        return self._out(sums - base[self.number])

    def head(self, values: np.ndarray) -> np.ndarray:
        """The first value of the run."""
        return self._out(self._in(values)[self.begin][self.number])

    def tail(self, values: np.ndarray) -> np.ndarray:
        """The last value of the run."""
        ends = np.append(self.begin[1:], len(self.first)) - 1
        return self._out(self._in(values)[ends][self.number])

    def most(self, values: np.ndarray) -> np.ndarray:
        """The largest value of the whole run."""
        return self._out(np.maximum.reduceat(self._in(values), self.begin)[self.number])

    def next(self, flags: np.ndarray) -> np.ndarray:
        """Row of the next later one of the run that has the flag, or the number of rows."""
        n = len(self.first)
        at = np.where(self._in(flags), np.arange(n), n)
        later = np.append(np.minimum.accumulate(at[::-1])[::-1][1:], n)
        ends = np.append(self.begin[1:], n)[self.number]
        rows = np.append(np.arange(n) if self.order is None else self.order, n)
        return self._out(np.where(later < ends, rows[np.minimum(later, n)], n))


class _Near:
    """Values of neighbouring rows of the same file."""

    def __init__(self, first: np.ndarray):
        self.n = len(first)
        begin = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        self.low, self.high = begin[number], np.append(begin[1:], self.n)[number]

    def __call__(self, values: np.ndarray, step: int, beyond) -> np.ndarray:
        at = np.arange(self.n) + step
        inside = (at >= self.low) & (at < self.high)
        return np.where(inside, values[np.clip(at, 0, self.n - 1)], beyond)


# --- rules -------------------------------------------------------------------


def _bracket_kinds(language, b1, b2, b1_name, b2_named) -> np.ndarray:
    """What a bracket is for: 0 anything, 1 parameters, 2 a block of declarations, 3 a group of names."""
    kind = np.zeros(len(language), np.int64)
    cpp = _CPP_HEADS[b1] | (b1_name & (b2_named | _CPP_RESULTS[b2]))
    csharp = _CSHARP_HEADS[b1] | (b1_name & (b2_named | _CSHARP_RESULTS[b2]))
    go = _FUNC[b1] | (b1_name & _FUNC_OR_RECEIVER[b2])
    kind[((language == _CPP) & cpp) | ((language == _CSHARP) & csharp) | ((language == _GO) & go)] = 1
    kind[(language == _GO) & _GO_DECLARES[b1]] = 2
    kind[(language == _PYTHON) & ~(b1_name | _VALUE_ENDS[b1])] = 3
    return kind


def hidden(first: np.ndarray, language: np.ndarray, word: np.ndarray, name: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which tokens are masked.

    One entry a token: whether it begins a file, its language, its word's number,
    whether it can be a declared name, and a number of its own for each token.
    """
    row = np.arange(len(word))
    near, files = _Near(first), _Runs(first)
    python = language == _PYTHON
    b1, b2, b3 = (near(word, -n, -1) for n in (1, 2, 3))
    a1, a2, a3 = (near(word, n, -1) for n in (1, 2, 3))
    is_type = _IS_TYPE[language, word]
    b1_name, b2_name = near(name, -1, False), near(name, -2, False)
    b1_type, b2_type = near(is_type, -1, False), near(is_type, -2, False)
    a1_name = near(name, 1, False)
    b2_named = b2_type | b2_name

    # Depths, statements (lines in Python), and the bracket around a token.
    depth, braces = files.total(_STEPS[word]), files.total(_BRACES[word])
    parts = _Runs(first | near(_ENDS_PART[language, word], -1, False))
    low, width = int(depth.min()), int(depth.max() - depth.min()) + 1
    level_parts = _Runs(key=parts.number * width + depth - low)
    kind = np.where(_OPENS_GROUP[word], row * 4 + _bracket_kinds(language, b1, b2, b1_name, b2_named), -1)
    around = _Runs(key=files.number * width + depth - low).largest(kind)
    around = np.where(around >= 0, around % 4, 0)
    ends, starts, base = parts.tail(word), parts.head(word), parts.head(depth)
    impure = parts.before(~(name | is_type | _IS_MARK[word]))
    angled = parts.before(word == _ANGLE)

    # C++ and C#: a type before the name, and what may follow it.
    pointed = _POINTERS[b1] & (b2_named | _CLOSED_ANGLE[b2]) & (~impure | (around == 1))
    wrapped = _SUFFIXES[b1] & (b2_named | _SQUARE_OPEN[b2])
    generic = _CLOSED_ANGLE[b1] & angled & (~impure | (around == 1))
    typed = name & (b1_type | b1_name | pointed | wrapped | generic)
    opened_by = (a1 == _COMMA) | ((a1 == _CALL) & (ends == _SEMICOLON)) | ((a1 == _BLOCK) & (a2 != _LINE) & (a2 != -1))
    typed &= np.where(
        language == _CPP,
        _CPP_AFTER[a1] | ((depth == braces) & opened_by),
        (language == _CSHARP) & _CSHARP_AFTER[a1],
    )
    listed = name & (depth == braces) & level_parts.before(typed) & (b1 == _COMMA)
    c_like = typed | (listed & _LIST_AFTER[a1])

    # Go: lists of names, from the first one on.
    member = (language == _GO) & name & ~b1_name & ~_GO_NOT_BEFORE[b1]
    leads = member & ~((b1 == _COMMA) & near(member, -2, False))
    lists = _Runs(first | leads)
    first_before = lists.head(b1)
    chains = _Runs(lists.first | ~(member | (word == _COMMA)))
    go_type = a1_name | _IS_GO_TYPE[a1] | (_SQUARE_OPEN[a1] & (a2 == _SQUARE))
    last = np.select(
        [go_type, a1 == _STAR, (a1 == _SHORT) & (a2 != _RANGE), a1 == _COMMA], [1, 2, 3, 0], default=-1
    )
    last = chains.most(np.where(member, last, -1))
    go = member & (
        _GO_DECLARES[first_before]
        | ((last == 3) & (first_before != _CASE))
        | ((around == 2) & _GROUP_STARTS[first_before])
        | ((last == 1) & _TYPED_STARTS[first_before])
        | ((last == 2) & (_STATEMENT_STARTS[first_before] | ((around == 1) & _PARAMETER_STARTS[first_before])))
    )

    # Python: assignments, and parameters up to the end of their header.
    starts_line = (b1 == -1) | _LINE_ENDS[b1]
    target = starts_line | _TARGET_BEFORE[b1] | ((b1 == _COLON) & _CLAUSE_ENDS[b2])
    line_depth = np.where(_OPENS_ANY[starts], base - 1, base)
    equals = parts.most(np.where(python & (word == _ASSIGN), row, -1))
    equals_depth = np.where(equals >= 0, depth[equals], -1)
    assigned = level_parts.before(_IS_ASSIGNMENT[word] & python)
    tupled = (
        (equals > row) & (equals_depth >= 0) & (equals_depth == line_depth) & ~assigned
        & ((depth == line_depth) | (around == 3)) & ~_PYTHON_HEADS[starts]
        & ((b1 == -1) | _TUPLE_BEFORE[b1]) & _TUPLE_AFTER[a1]
    )
    heads = python & ((word == _DEF) | (word == _LAMBDA))
    headers = _Runs(first | heads)
    header, opener, opened = headers.head(row), headers.head(np.where(heads, word, -1)), headers.head(depth)
    far = int(depth.max()) + 1
    lowest = -headers.largest(-np.where(row >= header + 2, depth, far))
    lowest_all = -headers.largest(-depth)
    over = headers.largest((word == _COLON) & (row > header) & (depth == opened)) > 0
    parameter = (
        (opener == _DEF) & (row - header >= 3) & (depth == opened + 1) & _DEF_BEFORE[b1] & (lowest > opened)
    )
    of_lambda = (
        (opener == _LAMBDA) & (row > header) & (depth == opened) & _LAMBDA_BEFORE[b1]
        & (lowest_all >= opened) & ~over
    )
    bound = (b1 == _AS) & (
        ((a1 == _COLON) & (b3 != _EXCEPT)) | ((a1 == _COMMA) & _WITH[starts])
    )
    matched = (b1 == _CASE) & _CASE_AFTER[a1]
    annotated = (a1 == _COLON) & (a3 == _ASSIGN) & starts_line
    pythonic = name & (
        (target & _IS_ASSIGNMENT[a1]) | tupled | annotated | bound | matched | parameter | of_lambda
    )

    declares = np.select([language <= _CSHARP, language == _GO, python], [c_like, go, pythonic], default=False)
    # A closing brace belongs to the level it closes.
    closes = word == _BRACE
    level = braces + closes
    low, width = int(level.min()), int(level.max() - level.min()) + 1
    scope_end = _Runs(key=files.number * width + level - low).next(closes)
    until = np.where(declares, np.where(python, len(row), scope_end), -1)
    return _Runs(key=files.number * (int(code.max()) + 1) + code).largest(until) > row


# --- batches -----------------------------------------------------------------


def _masked(lists: pa.ListArray, languages: list[str | None]) -> pa.ListArray:
    """Token lists with declared names replaced."""
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    known = {name: number for number, name in enumerate(_LANGUAGES)}
    language = np.repeat(np.array([known.get(name, _OTHER) for name in languages], np.int64), lengths)
    flat = lists.flatten()
    if not len(flat) or (language == _OTHER).all():
        return lists
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy().astype(np.int64)
    number = np.array([_NUMBERS.get(word, 0) for word in words], np.int64)
    named = np.array([[_ascii_name(word), _unicode_name(word)] for word in words])
    word = number[code]
    name = np.where(language == _CPP, named[code, 0], named[code, 1]) & ~_IS_RESERVED[language, word]
    begin = np.zeros(len(code), bool)
    begin[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    shown = np.where(hidden(begin, language, word, name, code), len(words), code)
    values = pa.concat_arrays([coded.dictionary, pa.array([VARIABLE], coded.dictionary.type)]).take(pa.array(shown))
    offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, type=lists.type, mask=lists.is_null())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy()
        chunk = (np.cumsum(lengths) - lengths) // CHUNK_TOKENS
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist() + [batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            part = batch.slice(low, high - low)
            masked = _masked(part.column("tokens"), part.column("language").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("language"), masked], schema=batch.schema)


def masked_tokens(tokenised: DataFrame) -> DataFrame:
    """(doc_id, language, tokens) with declared names masked."""
    rows = tokenised.select("doc_id", "language", "tokens")
    return rows.mapInArrow(_batches, rows.schema)
