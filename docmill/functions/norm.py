"""Normalisation of values as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \\s see it; Java's \\s is ASCII only.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: long expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, hence Arrow batches; nulls stay null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))

    return run(c)


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as ASCII, within the JVM."""
    return F.translate(c, _WIDE, _ASCII)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def compact(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"[{SPACE}]+", "")


def compact_length(c: Column) -> Column:
    """Code points that aren't white space."""
    return F.char_length(compact(c))


def stock_code(c: Column) -> Column:
    """Digits (with or without .0) of at most six places padded to six; anything else trimmed."""
    s = F.trim(c.cast("string"))
    whole = F.regexp_extract(s, r"^(\d+)(\.0+)?$", 1)
    return F.when((whole != "") & (F.length(whole) <= 6), F.lpad(whole, 6, "0")).otherwise(s)


def unit_text(c: Column, exact: bool = True) -> Column:
    """One kind of line end, runs of spaces and tabs as one space, stripped; NFKC first if ``exact``."""
    s = nfkc(c) if exact else fold_width(c)
    return strip(F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), "[ \t]+", " "))


def chapter_title(c: Column, exact: bool = True) -> Column:
    """White space as single spaces, without hyphens and spaces at the ends."""
    s = F.regexp_replace(nfkc(c) if exact else fold_width(c), f"[{SPACE}]+", " ")
    return F.regexp_replace(strip(s), "^[- ]+|[- ]+$", "")


def plain_text(c: Column, exact: bool = True) -> Column:
    """Width, dashes and brackets in one form; null for null and blank."""
    s = strip(nfkc(c) if exact else fold_width(c))
    return F.nullif(F.translate(s, "–—－（）", "---()"), F.lit(""))


def standard_code(c: Column, exact: bool = True) -> Column:
    """struct(base, version) of a standard's code; the version is the year as written, both null for blank values.

    ``GB/T 19001-2016`` gives (GB/T19001, 2016). Codes of another form keep everything before a last hyphen
    with two to four digits behind it, or else everything, as the base, without spaces and hyphens.
    """
    main = r"^([A-Z]+(?:/[A-Z]+)?\s*\d+(?:\.\d+)*)(?:[-:](\d{2,4}))?$"
    tail = r"^(.*)-(\d{2,4})$"
    bare = lambda x: F.regexp_replace(x, "[ -]", "")

    def parts(s: Column) -> Column:
        base = F.when(s.rlike(main), F.regexp_replace(F.regexp_extract(s, main, 1), " ", "")).when(s.rlike(tail), bare(F.regexp_extract(s, tail, 1))).otherwise(bare(s))
        version = F.when(s.rlike(main), F.regexp_extract(s, main, 2)).when(s.rlike(tail), F.regexp_extract(s, tail, 2))
        return F.struct(base.alias("base"), F.nullif(version, F.lit("")).alias("version"))

    return let(F.upper(strip(F.regexp_replace(plain_text(c, exact), f"[{SPACE}]+", " "))), parts)


def full_year(version: Column) -> Column:
    """Four digits as they are, two digits as 1951 to 2050, else 0."""
    n = version.try_cast("int")
    return F.when(F.length(version) == 4, n).when(F.length(version) == 2, n + F.when(n > 50, 1900).otherwise(2000)).otherwise(F.lit(0))


def report_year(c: Column, exact: bool = True) -> Column:
    """The first four digits that stand alone, else two digits alone; null otherwise (also for 2024年: 年 is a word character)."""
    alone = r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])"
    return let(plain_text(c, exact), lambda s: F.when(s.rlike(alone), F.regexp_extract(s, alone, 1).try_cast("int")).when(s.rlike(r"^\d{2}$"), full_year(s)))


def optional(c: Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def tolerant_bool(c: Column) -> Column:
    """true, 1, yes and y in any case are true; all else, null included, is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def line_preview(c: Column, chars: int = 300) -> Column:
    """The beginning of a text on one line: line ends are written as \\n."""
    return F.substring(F.replace(F.regexp_replace(c, "\r\n?", "\n"), F.lit("\n"), F.lit("\\n")), 1, chars)


def truncated(c: Column, chars: int = 4000) -> Column:
    """Cut at a length, with a note of how much is missing; nulls stay null."""
    n = F.char_length(c)
    return F.when(n > chars, F.concat(F.substring(c, 1, chars), F.lit("...[truncated "), (n - chars).cast("string"), F.lit(" chars]"))).otherwise(c)


def head_and_tail(c: Column, head: int = 2000, tail: int = 1000) -> Column:
    """Beginning and end of a long response; one between the two lengths keeps its beginning only; null gives the empty string."""
    n = F.char_length(c)
    long = F.concat(F.substring(c, 1, head), F.lit("\n...[truncated "), (n - head - tail).cast("string"), F.lit(" chars]...\n"), F.right(c, F.lit(tail)))
    return F.coalesce(F.when(n > head + tail, long).otherwise(F.substring(c, 1, head)), F.lit(""))


def matching_form(c: Column) -> Column:
    """For comparing quotations: no white space, ASCII quotation marks and punctuation, lower case."""
    return F.lower(F.translate(compact(c), "“”‘’，．：；（）", "\"\"'',.:;()"))


def grounded(part: Column, source: Column) -> Column:
    """Whether a non-blank part stands in the source, both in matching form; false for nulls."""
    p = matching_form(part)
    return F.coalesce((p != "") & F.contains(matching_form(source), p), F.lit(False))
