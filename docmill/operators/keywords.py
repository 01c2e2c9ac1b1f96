"""Keyword dictionaries: whether and which terms stand in a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.lines import has_term

_ASCII = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def term_order(terms: list[str]) -> list[str]:
    """Distinct terms, longest first, ties by text."""
    return sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))


def find_terms(text: str, terms: list[str]) -> list[str]:
    """Terms that stand in the text, each at its first place that touches no ASCII letter at an ASCII end and no longer term's place."""
    low, taken, out = text.lower(), bytearray(len(text)), []
    for term in terms:
        t = term.lower()
        at = low.find(t)
        while at >= 0:
            end = at + len(t)
            free = not (at and t[0] in _ASCII and low[at - 1] in _ASCII) and not (end < len(low) and t[-1] in _ASCII and low[end] in _ASCII)
            if free and not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                out.append(term)
                break
            at = low.find(t, at + 1 if free else end)
    return out


def matched_terms(text: Column, terms: list[str]) -> Column:
    """find_terms as a Column; nulls give an empty array. Overlaps need a memory of places, hence an Arrow batch."""
    ordered = term_order(terms)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: find_terms(t, ordered) if t else [])

    return F.pandas_udf(run, "array<string>")(text)


def keyword_features(units: DataFrame, terms: list[str]) -> DataFrame:
    """text_unit_id, keyword_candidate and matched_terms of every unit. The flag is decided in the JVM; only units that have it
    go through Python for the terms."""
    flagged = units.select("text_unit_id", "text", has_term(F.col("text"), terms).alias("keyword_candidate"))
    hit = flagged.where("keyword_candidate").withColumn("matched_terms", matched_terms(F.col("text"), terms))
    miss = flagged.where("not keyword_candidate").withColumn("matched_terms", F.expr("cast(array() as array<string>)"))
    return hit.unionByName(miss).drop("text")
