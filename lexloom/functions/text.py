"""Scalar and array helpers on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last second of year 9999, and of what a timestamp in microseconds can hold.
_LAST_SECOND = 253_402_300_799
_LAST_STAMP = 9_223_372_036_853


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def blob_id(content: Column) -> Column:
    """Object id that version control gives a file with this content."""
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0"))
    return F.sha1(F.concat(header, content))


def byte_length(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def file_extension(path: Column) -> Column:
    """Text after the last dot of the whole path, NULL without a dot."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1))


def strip_dots(ext: Column) -> Column:
    return F.replace(ext, F.lit("."), F.lit(""))


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as date and time in the session's zone; other text unchanged."""
    number = F.when(seconds.rlike(r"^[+-]?[0-9]+$"), seconds.try_cast("bigint"))
    stamp = F.when(number.between(-_LAST_SECOND, _LAST_STAMP), F.timestamp_seconds(number))
    # Years beyond 9999 are written out without a sign.
    shown = F.when(number <= _LAST_SECOND, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(stamp, "y-MM-dd HH:mm:ss")
    )
    return F.coalesce(shown, seconds)


def prefix_words(tokens: Column, language: Column, words: list[str]) -> Column:
    """`if` becomes `Python_if` for the listed words."""
    return F.transform(
        tokens,
        lambda t: F.when(t.isin(words), F.concat(language, F.lit("_"), t)).otherwise(t),
    )


def label_language(label: Column) -> Column:
    parts = F.split(label, "_", -1)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise("")


def label_keyword(label: Column) -> Column:
    parts = F.split(label, "_", -1)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(label)


def joined_document(tokens: Column) -> Column:
    """Tokens joined by blanks, with a line break after every colon."""
    return F.replace(F.array_join(tokens, " "), F.lit(":"), F.lit(":\n"))


def sheet_row(*cells: Column) -> Column:
    """`| a | b |` row of a summary sheet."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def decoded(content: Column, charset: Column) -> Column:
    """Bytes in a named charset as text; NULL where they are malformed or the charset is unknown."""
    name = F.upper(charset)
    units = _spaced_units(content, 4)
    swapped = F.regexp_replace(units, r"(..)(..) ", "$2$1 ")
    little = (name == "UTF-16LE") | ((name == "UTF-16") & units.startswith("FFFE "))
    ok = (
        F.when(name.isin("UTF-8", "UTF8"), F.is_valid_utf8(content))
        .when(name == "US-ASCII", ~F.hex(content).rlike("^(?:..)*?[89A-F]"))
        .when(name == "ISO-8859-1", F.lit(True))
        .when(
            name.isin("UTF-16", "UTF-16BE", "UTF-16LE"),
            (F.length(content) % 2 == 0) & ~F.when(little, swapped).otherwise(units).rlike(_LONE_SURROGATE),
        )
        .when(
            name == "UTF-32",
            (F.length(content) % 4 == 0) & ~_spaced_units(content, 8).rlike(_NO_CODE_POINT),
        )
    )
    known = F.when(name == "UTF8", "UTF-8").otherwise(name)
    return F.when(ok, F.call_function("decode", content, known))


# In hex digits: half of a surrogate pair alone; no code point in four bytes.
_LONE_SURROGATE = r"\bD[89AB].. (?!D[C-F])|(?<!\bD[89AB].. )\bD[C-F].. "
_NO_CODE_POINT = r"\b(?!0000(?!D[89A-F])|000[1-9A-F]|0010)[0-9A-F]{8} "


def _spaced_units(content: Column, digits: int) -> Column:
    """Hex digits of the content in groups, each followed by a blank."""
    return F.regexp_replace(F.hex(content), f"(.{{{digits}}})", "$1 ")
