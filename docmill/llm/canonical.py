"""Mapping free-entered values to a reference list by symmetric deletes (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.confusable import HYPHENS, INVISIBLE, LOOK_ALIKES, SPACES
from docmill.session import cut, free_name

#: Delete keys of a reference list that are indexed and broadcast (about 100 bytes each). They are counted by length before anything
#: is collected; a list with more is joined by its keys instead.
BROADCAST_KEYS = 1_000_000

_PLAIN = str.maketrans({**LOOK_ALIKES, **{c: "-" for c in HYPHENS}, **{c: " " for c in SPACES}, **{c: None for c in INVISIBLE}})
# Digits as Chinese numerals, and letters that are typed or read for digits.
_NUMERALS = str.maketrans("〇零一二三四五六七八九", "00123456789")
_DIGIT_LIKE = str.maketrans("OoQDIlL|iSsZzB", "00001111155228")
#: Pairs of digits that are easily confused; such an error weighs less in the ranking.
_NEAR = {frozenset(p) for p in ("01", "17", "38", "56", "58", "68", "69", "80", "27", "49")}


def deletes(term: str, most: int) -> set[str]:
    """The term and all strings that deleting up to ``most`` of its characters gives."""
    found = {term}
    for n in range(1, min(most, len(term)) + 1):
        for gone in combinations(range(len(term)), n):
            drop = set(gone)
            found.add("".join(c for i, c in enumerate(term) if i not in drop))
    return found


def edit_distance(a: str, b: str) -> tuple[int, float]:
    """(edits, weight): Damerau-Levenshtein with neighbours swapped once; the weight is lower for likely errors."""
    rows: list[list[tuple[int, float]]] = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            add = lambda cell, n, w: (cell[0] + n, cell[1] + w)
            change = (0, 0.0) if x == y else (1, 0.6 if frozenset((x, y)) in _NEAR else 1.0)
            best = min(add(rows[i - 1][j], 1, 0.9), add(row[j - 1], 1, 0.9), add(rows[i - 1][j - 1], *change))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, add(rows[i - 2][j - 2], 1, 0.7))
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@dataclass
class DeleteIndex:
    """Terms by their delete keys."""

    most: int
    query_deletes: int
    by_key: dict[str, list[int]]
    terms: list[tuple[str, str, int]]
    longest: int

    @classmethod
    def of(cls, terms: list[tuple[str, str, int]], most: int, query_deletes: int) -> DeleteIndex:
        """terms: (term, code, frequency). query_deletes: 0 if a query may only lack characters, else as ``most``."""
        by_key: dict[str, list[int]] = defaultdict(list)
        for i, (term, _, _) in enumerate(terms):
            for key in deletes(term, most):
                by_key[key].append(i)
        return cls(most, query_deletes, dict(by_key), terms, max((len(t) for t, _, _ in terms), default=0))

    def find(self, query: str) -> list[tuple[int, float, int, str]]:
        """(edits, weight, -frequency, code) of every term within ``most`` edits, best first."""
        if not query or len(query) > self.longest + self.most:  # no term is near a query so long
            return []
        hits = {i for key in deletes(query, self.query_deletes) for i in self.by_key.get(key, ())}
        ranked = []
        for i in hits:
            term, code, frequency = self.terms[i]
            edits, weight = edit_distance(query, term) if self.query_deletes else (len(term) - len(query), 0.9 * (len(term) - len(query)))
            if edits <= self.most:
                ranked.append((edits, weight, -frequency, code))
        return sorted(ranked)


def plain(value: str) -> str:
    """One form of width, look-alikes, spaces and invisible characters, upper case."""
    return unicodedata.normalize("NFKC", value.translate(_PLAIN)).upper().strip()


_SPACED = re.compile(r"^(?:[^\s\d一-鿿]|[A-Z])(?:\s+\S){3,}\s*$")
_NUMBER = re.compile(r"(?<![\d第])(?<!\d\.)(\d[\dOoQIlL|SZB]{2,7}(?:\.[\dOIlL|SZB]{1,2})?)(?!部分)")
_HAN = re.compile(r"[〇零一二三四五六七八九]{3,8}(?:\.[〇零一二三四五六七八九]{1,2})?")
_YEAR = re.compile(r"\s*[(\[]?(?:19|20)\d{2}\s*(?:版|年版)?[)\]]?")


def standard_parts(value: str) -> tuple[str, list[str]]:
    """The number of a standard as someone typed it (or "") and its name, as variants without added words.

    Version years, prefixes, quotation marks and words such as 标准 or 认证 don't count.
    """
    s = plain(value)
    if _SPACED.match(s):
        s = re.sub(r"\s+", "", s)
    number, rest = "", s
    if m := _HAN.search(s):
        number, rest = m[0].translate(_NUMERALS), s[m.end() :]
    elif m := _NUMBER.search(s):
        number, rest = m[1].translate(_DIGIT_LIKE), s[m.end() :]
        if not re.search(r"[A-Z./]|国标|标准|NO", s[: m.start()]) and re.search(r"[一-鿿]{3}", s[: m.start()]):
            number, rest = "", s  # a figure inside a name
    rest = _YEAR.sub(" ", re.sub(r"^\s*[-:_/]\s*\d{2,4}(?!\d)", " ", rest)) if number else rest
    name = re.sub(r"[^一-鿿0-9A-Z]", "", rest)
    variants = [name] if len(re.sub(r"[^一-鿿]", "", name)) >= 3 else []
    for added in ("标准要求", "标准认证", "标准", "认证"):
        if name.endswith(added) and len(name) - len(added) >= 3:
            variants.append(name[: -len(added)])
    return number, variants


def best_of(candidates: list[tuple[int, float, int, str]], only: bool = False) -> str | None:
    """The code of the candidate with the least weight, then the greatest frequency; null if two codes tie, or if ``only``
    asks for a single code and there are several."""
    codes = {c[3] for c in candidates}
    if not codes or only and len(codes) > 1:
        return next(iter(codes)) if len(codes) == 1 else None
    ranked = sorted({(w, f, code) for _, w, f, code in candidates})
    tied = {code for w, f, code in ranked if (w, f) == ranked[0][:2]}
    return ranked[0][2] if len(tied) == 1 else None


def decide(candidates: list[tuple[str, int, float, int, str]], only: bool = False) -> tuple[str | None, int | None, str]:
    """(code, edits, how): the exact number, else the best number within reach, else the best name.

    Several numbers within reach are told apart by the nearest name if there is one, then by weight and frequency (see
    best_of); with ``only`` they are ambiguous instead. ``how`` is number, name, ambiguous or none.
    """
    numbers, names = ([c[1:] for c in candidates if c[0] == by] for by in ("number", "name"))
    nearest = [c for c in names if c[0] == min(x[0] for x in names)]
    named = {c[3] for c in nearest}
    for reach in (0, 1):
        near = [c for c in numbers if c[0] <= reach]
        both = [c for c in near if c[3] in named]
        if (code := best_of(both or near, only)) is not None:
            return code, reach, "number"
    if (code := best_of(nearest, only)) is not None:
        return code, nearest[0][0], "name"
    return None, None, "ambiguous" if numbers or nearest else "none"


def decide_entry(candidates: list[tuple[str, int, float, int, str]], only: bool = False) -> tuple[str | None, int | None, str]:
    """(entry, edits, how) for an ordinary list: the entry with the least weight, then the most frequent one."""
    near = [c[1:] for c in candidates]
    code = best_of(near, only)
    if code is None:
        return None, None, "ambiguous" if near else "none"
    edits = min(c[0] for c in near if c[3] == code)
    return code, edits, "exact" if edits == 0 else "near"


def entry_key(value: str) -> str:
    """The letters and digits of an entry in one form of width, look-alikes and case."""
    return re.sub(r"[^\w]|_", "", plain(value))


@dataclass(frozen=True)
class Field:
    """One way to find an entry: its kind, edits allowed, and whether the query may only lack characters."""

    by: str
    most: int
    lacking: bool = False


STANDARD_FIELDS, ENTRY_FIELDS = (Field("number", 1), Field("name", 2, True)), (Field("entry", 2),)


def standard_queries(value: str) -> list[tuple[str, str]]:
    number, names = standard_parts(value)
    return ([("number", number)] if number else []) + [("name", n) for n in names]


def standard_terms(code: str, name: str | None) -> list[tuple[str, str]]:
    found = [("number", m[0])] if (m := re.search(r"\d.*$", plain(code))) else []
    key = re.sub(r"[^一-鿿0-9A-Z]", "", plain(name or ""))
    return found + ([("name", key)] if key else [])


def entry_terms(code: str, _: str | None) -> list[tuple[str, str]]:
    return [("entry", key)] if (key := entry_key(code)) else []


def entry_queries(value: str) -> list[tuple[str, str]]:
    return entry_terms(value, None)


def _mapped(df: DataFrame, value: str, terms: DataFrame, fields: tuple[Field, ...], terms_of: Callable, queries_of: Callable, settle: Callable, out: list[str], most_keys: int) -> DataFrame:
    """df with the three columns ``out``; terms: code, name, n (frequency)."""
    spark = df.sparkSession
    schema = "`{}` string, `{}` int, `{}` string".format(*out)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(by, term, c, n) for c, name, n in pdf[["code", "name", "n"]].itertuples(index=False) for by, term in terms_of(c, name)], columns=["f", "term", "code", "n"])

    listed = cut(terms.mapInPandas(spelled, "f string, term string, code string, n long").groupBy("f", "term", "code").agg(F.sum("n").alias("n")))
    size, most = F.char_length("term"), F.when(F.col("f") == fields[0].by, fields[0].most).otherwise(fields[-1].most)
    n_keys, longest = listed.agg(F.coalesce(F.sum(1 + size + F.when(most > 1, size * (size - 1) / 2).otherwise(0)), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).head()
    if n_keys <= most_keys:
        rows: dict[str, list] = defaultdict(list)
        for r in listed.collect():
            rows[r["f"]].append((r["term"], r["code"], r["n"]))
        shared = spark.sparkContext.broadcast({f.by: DeleteIndex.of(sorted(rows[f.by]), f.most, 0 if f.lacking else f.most) for f in fields})

        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                find = lambda v: sorted({(by, *x) for by, q in queries_of(v) for x in shared.value[by].find(q)})
                known = {v: settle(find(v)) for v in s.dropna().unique() if v}
                yield pd.DataFrame([known.get(v, (None, None, "none")) for v in s], columns=out).astype({out[1]: "Int32"})

        found = free_name("found", df)
        return df.withColumn(found, F.pandas_udf(look_up, schema)(F.col(value))).select(*df.columns, *[F.col(f"{found}.{c}").alias(c) for c in out])

    rule = {f.by: f for f in fields}

    def keyed_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 200):
                yield pd.DataFrame([(f, key, term, c, n) for f, term, c, n in pdf.iloc[k : k + 200][["f", "term", "code", "n"]].itertuples(index=False) for key in deletes(term, rule[f].most)], columns=["f", "k", "term", "code", "n"])

    def keyed_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                yield pd.DataFrame([(f, key, v, q) for v in pdf["v"].iloc[k : k + 500] for f, q in queries_of(v) if len(q) <= longest + rule[f].most for key in deletes(q, 0 if rule[f].lacking else rule[f].most)], columns=["f", "k", "v", "q"])

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scored = [(v, f, *(edit_distance(q, term) if not rule[f].lacking else (len(term) - len(q), 0.9 * (len(term) - len(q)))), -n, c) for f, v, q, term, c, n in pdf[["f", "v", "q", "term", "code", "n"]].itertuples(index=False)]
            yield pd.DataFrame([x for x in scored if x[2] <= rule[x[1]].most], columns=["v", "f", "e", "w", "n", "code"])

    distinct = cut(df.select(F.col(value).alias("v")).where("v is not null and v <> ''").distinct())
    pairs = distinct.mapInPandas(keyed_values, "f string, k string, v string, q string").join(listed.mapInPandas(keyed_terms, "f string, k string, term string, code string, n long"), ["f", "k"])
    near = pairs.select("f", "v", "q", "term", "code", "n").distinct().mapInPandas(distances, "v string, f string, e int, w double, n long, code string")

    def settle_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([settle(sorted({(x["f"], x["e"], x["w"], x["n"], x["code"]) for x in c})) for c in s], columns=out).astype({out[1]: "Int32"})

    settled = near.groupBy("v").agg(F.collect_list(F.struct("f", "e", "w", "n", "code")).alias("c")).select("v", F.pandas_udf(settle_all, schema)("c").alias("m"))
    v = free_name("v", df)
    return df.join(settled.select(F.col("v").alias(v), *[F.col(f"m.{c}").alias(c) for c in out]), F.col(value) == F.col(v), "left").drop(v).fillna("none", [out[2]])


def _counted(reference: DataFrame, code: str, name: str | None) -> DataFrame:
    return reference.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code"), (F.col(name) if name else F.lit(None).cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def map_to_list(df: DataFrame, value: str, reference: DataFrame, entry: str, only: bool = False, most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """df with ``matched_entry``, ``matched_edits`` and ``matched_by`` (exact, near, ambiguous, none) from a list of cities, brands, titles or the like.

    Letters and digits are compared in one form of width, case and look-alikes, with at most two edits (neighbours swapped count as
    one). Of several entries within reach the one with the least weighted distance is taken, then the one that the reference
    list has most often; entries equal in both are ambiguous, and with ``only`` any two are. Null and empty values, and values
    farther away, give a null entry; nulls in the list are left out. All columns of df are kept; clashing ones
    give the new columns a leading underscore. A list too long to be broadcast is joined by its delete keys.
    """
    out = [free_name(n, df) for n in ("matched_entry", "matched_edits", "matched_by")]
    return _mapped(df, value, _counted(reference, entry, None), ENTRY_FIELDS, entry_terms, entry_queries, lambda c: decide_entry(c, only), out, most_keys)


def map_to_standards(df: DataFrame, value: str, reference: DataFrame, code: str, name: str, only: bool = True, most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """df with ``matched_code``, ``matched_edits`` and ``matched_by`` (number, name, ambiguous, none).

    The reference list is indexed by symmetric deletes and broadcast if its keys, counted before, are few enough; each batch then
    looks up its distinct values once, and no row is shuffled. Otherwise distinct values and terms are joined by their
    delete keys. Candidates are ranked by weighted distance, then by how often the list has them; with ``only`` a
    number or a name within reach must leave one entry, and is ambiguous otherwise.

    A null or empty value, an empty list, and a value farther away than one edit of a number or two missing characters
    of a name give a null code. Reference rows without a code are left out; repeated ones count as frequency. All columns of df
    are kept; clashing ones give the new columns a leading underscore.
    """
    out = [free_name(n, df) for n in ("matched_code", "matched_edits", "matched_by")]
    return _mapped(df, value, _counted(reference, code, name), STANDARD_FIELDS, standard_terms, standard_queries, lambda c: decide(c, only), out, most_keys)
