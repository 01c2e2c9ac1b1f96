"""Splitting oversized texts at natural boundaries, with overlap (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import free_name

#: Where each level may cut, coarsest first: after a match of the pattern. The last resort, between any two
#: characters, needs no pattern.
LEVELS = (
    re.compile(r"\n(?=[ \t　]*(?:第[一二三四五六七八九十百0-9]+[章节]|[（(][一二三四五六七八九十]+[)）]|[一二三四五六七八九十]+、|#{1,6} ))"),  # section
    re.compile(r"\n[ \t　]*\n+|\n"),  # paragraph
    re.compile(r"[。！？!?；;…]+[”’」』）)\"']*|\.(?=\s)[\"')]*\s*"),  # sentence
    re.compile(r"[，,、：:]|\s+"),  # word
)


def _cuts(text: str, lo: int, hi: int, level: int) -> list[int]:
    return [m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi]


def boundaries(text: str, room: int, lo: int = 0, hi: int | None = None, level: int = 0) -> list[int]:
    """Ends of the atoms that text[lo:hi] falls into, each at most ``room`` long.

    A stretch is only split by a finer separator if it doesn't fit.
    """
    hi = len(text) if hi is None else hi
    if hi - lo <= room:
        return [hi]
    if level == len(LEVELS):
        return [*range(lo + room, hi, room), hi]
    ends, at = [], lo
    for cut in [*_cuts(text, lo, hi, level), hi]:
        ends += boundaries(text, room, at, cut, level + 1) if cut - at > room else [cut]
        at = cut
    return ends


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of at most ``limit`` code points; each after the first begins with the last ``overlap`` of the one before.

    Without the overlaps the pieces put together are the text. Atoms are packed greedily. A text within the
    limit is one piece. Only if a piece would otherwise be shorter than the overlap is an atom cut earlier.
    """
    if len(text) <= limit:
        return [text]
    room = limit - overlap
    spans: list[tuple[int, int]] = []
    start, end = 0, 0
    for stop in boundaries(text, room):
        most = limit if not spans else room
        if stop - start <= most:
            end = stop
            continue
        if end - start < (overlap if not spans else 1):  # the first piece must hold the overlap
            end = start + most
        spans.append((start, end))
        start, end = end, stop
        while end - start > room:
            spans.append((start, start + room))
            start += room
    spans.append((start, end))
    return [text[s if not i else s - overlap : e] for i, (s, e) in enumerate(spans)]


def split_oversized(df: DataFrame, text: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Each row as one or more rows with ``piece_no`` (from 1), ``pieces`` and ``piece``.

    A text longer than ``limit`` code points is cut by a hierarchy of separators (section, paragraph, sentence, word,
    character), each used only inside a stretch that the coarser one leaves too long; the parts are packed greedily,
    and every piece after the first begins with the last ``overlap`` characters of the one before. Texts within the
    limit, empty texts and nulls come out as one piece, unchanged, without leaving the JVM. Repeated rows are
    split each on its own. All other columns are kept; where they clash with the new names, those get a leading
    underscore.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    number, count, piece = (free_name(n, df) for n in ("piece_no", "pieces", "piece"))
    long = F.coalesce(F.char_length(F.col(text)) > limit, F.lit(False))
    names = df.columns
    parts, at = free_name("parts", df), free_name("at", df)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_text(t, limit, overlap))

    # Not deterministic to the optimiser, which would otherwise cut twice: for the size and for the pieces.
    cut_udf = F.pandas_udf(cut, "array<string>").asNondeterministic()
    whole = df.where(~long).select(*names, F.lit(1).alias(number), F.lit(1).alias(count), F.col(text).alias(piece))
    split = df.where(long).withColumn(parts, cut_udf(F.col(text)))
    split = split.select(*names, F.size(parts).alias(count), F.posexplode(parts).alias(at, piece))
    return whole.unionByName(split.select(*names, (F.col(at) + 1).alias(number), count, piece))
