"""A modified Kneser-Ney model of characters, counted and fitted by Spark, and kept in sorted arrays of packed n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.rolling import sub_batches
from docmill.session import cut

ORDER = 4
#: Entries of sorted arrays that are broadcast (about 16 bytes each). It bounds memory only: what isn't in the arrays is looked up by a join.
BROADCAST_ENTRIES = 4_000_000
_BITS = 16
FLOOR = 1e-6


def unit_codes(stream: np.ndarray) -> np.ndarray:
    """Code points as 16-bit units: those beyond the basic plane share the private area; 0 marks the start."""
    s = stream.astype(np.uint32)
    return np.where(s > 0xFFFF, 0xE000 + s % 0x1900, s).astype(np.uint64)


def packed(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, n-gram) of every character of a batch: itself and the three before it, packed exactly into 64 bits.

    Characters before the start of a text are 0.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    row = np.repeat(np.arange(len(streams)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = unit_codes(np.concatenate(streams)) if len(row) else np.zeros(0, np.uint64)
    gram = codes.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(codes)
        earlier[back:] = codes[:-back] if back < len(codes) else 0
        gram |= np.where(at >= back, earlier, 0).astype(np.uint64) << np.uint64(_BITS * back)
    return row, at, gram


def count_grams(df: DataFrame, stream_of: Callable, lang: str | None, text: str) -> DataFrame:
    """(lang, gram, n): how often every n-gram of the highest order stands in the texts.

    Each batch counts by itself before anything is shuffled. stream_of makes a text's characters an array; without a
    column of languages it gives the language too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in sub_batches(batch, "text")):
            streams: dict[str, list[np.ndarray]] = {}
            for name, t in zip(pdf["lang"], pdf["text"]):
                name, stream = (name, stream_of(t)) if lang else stream_of(t)
                streams.setdefault(name, []).append(stream)
            for name in sorted(streams):
                _, _, gram = packed(streams[name])
                keys, n = np.unique(gram, return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": keys.view(np.int64), "n": n.astype("int64")})

    parts = df.select((F.col(lang) if lang else F.lit("")).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").mapInPandas(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """For each order the n-grams of a language in a sorted array, with their probabilities and the contexts' leftovers."""

    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    leftovers: list[np.ndarray]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def probability(self, gram: np.ndarray, upto: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram after the ones before it, using n-grams of at most ``upto``.

        A stored probability already holds the shorter n-grams, so only those that aren't stored are backed off.
        """
        if not upto:
            return np.full(len(gram), FLOOR)
        g = gram & np.uint64((1 << (_BITS * upto)) - 1) if upto < ORDER else gram
        at, hit = self._find(self.keys[upto - 1], g)
        p = np.empty(len(gram))
        p[hit] = self.probs[upto - 1][at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            c_at, known = self._find(self.contexts[upto - 1], g[rest] >> np.uint64(_BITS))
            left = np.ones(len(rest))
            left[known] = self.leftovers[upto - 1][c_at[known]]
            p[rest] = left * self.probability(gram[rest], upto - 1)
        return np.maximum(p, 1e-12) if upto == ORDER else p


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts, kept inside their valid range."""
    if not n1:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    ds = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1))
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(ds, 1))  # type: ignore[return-value]


def fit(grams: DataFrame) -> list[DataFrame]:
    """(lang, gram, n, p, left) of every n-gram of each order from the counts of the highest one: its probability, and the leftover of its context.

    Lower orders count in how many contexts an n-gram stands. Counts, counts of counts, context totals and probabilities are all made
    by Spark from all n-grams, and none is left out. No key of a join stands in more rows than there are characters.
    """
    orders = [cut(grams)]
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * n)) - 1))
        orders.insert(0, cut(orders[0].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    tables: list[DataFrame] = []
    # At most five rows a language and order.
    of_counts: dict[int, dict[str, dict[int, int]]] = {n: {} for n in range(1, ORDER + 1)}
    for r in reduce(DataFrame.unionByName, [t.groupBy("lang", F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("c")).withColumn("o", F.lit(n)) for n, t in enumerate(orders, 1)]).collect():
        of_counts[r["o"]].setdefault(r["lang"], {})[r["k"]] = r["c"]
    for n, table in enumerate(orders, 1):
        rows = [(lang, *discounts(*(c.get(k, 0) for k in (1, 2, 3, 4))), 1.0 / (sum(c.values()) + 1)) for lang, c in sorted(of_counts[n].items())]
        steps = F.broadcast(table.sparkSession.createDataFrame(rows, "lang string, d1 double, d2 double, d3 double, even double"))
        own = table.join(steps, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("h", F.shiftrightunsigned("gram", _BITS))
        totals = own.groupBy("lang", "h").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
        own = own.join(totals, ["lang", "h"]).withColumn("left", F.col("lost") / F.col("total")).withColumn("main", (F.col("n") - F.col("d")) / F.col("total"))
        if n == 1:
            own = own.withColumn("lower", F.col("even"))
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (_BITS * (n - 1))) - 1))).join(tables[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        tables.append(cut(own.select("lang", "gram", "n", (F.col("main") + F.col("left") * F.col("lower")).alias("p"), "left")))
    return tables


def arrays(tables: list[DataFrame], most: int | None = None) -> dict[str, KneserNey] | None:
    """The model of each language in sorted arrays, or null if it has too many entries to be broadcast."""
    sizes = reduce(DataFrame.unionByName, [t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")) for t in tables]).groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row a language
    if sum(r["n"] for r in sizes) > (BROADCAST_ENTRIES if most is None else most):
        return None
    models: dict[str, KneserNey] = {}
    for table in tables:
        for lang in sorted(r["lang"] for r in sizes):
            # One language and order at a time is all that the driver holds beside the models.
            rows = table.where(F.col("lang") == lang).select("gram", F.col("p").cast("float"), F.col("left").cast("float")).toArrow()
            keys = rows["gram"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            keys = keys[order]
            contexts, first = np.unique(keys >> np.uint64(_BITS), return_index=True)
            model = models.setdefault(lang, KneserNey([], [], [], []))
            model.keys.append(keys)
            model.probs.append(rows["p"].to_numpy()[order])
            model.contexts.append(contexts)
            model.leftovers.append(rows["left"].to_numpy()[order[first]])
    return models


def frequent(table: DataFrame, most: int | None = None) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], bool]:
    """(sorted n-grams and probabilities of each language, whether these are all): the most frequent of one order that can be broadcast."""
    most = BROADCAST_ENTRIES if most is None else most
    level = F.floor(F.log2("n") * 4)
    room, least, complete = most, 1 << 30, True
    # Sizes by class of frequency, at most a few hundred rows, say which classes fit.
    for r in sorted(table.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["b"]):
        room -= r["c"]
        if room < 0:
            complete = False
            break
        least = r["b"]
    chosen = cut(table.where(level >= least).select("lang", "gram", F.col("p").cast("float")))
    found = {}
    for lang in sorted(r["lang"] for r in chosen.select("lang").distinct().collect()):
        rows = chosen.where(F.col("lang") == lang).select("gram", "p").toArrow()
        keys = rows["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        found[lang] = (keys[order], rows["p"].to_numpy()[order])
    return found, complete


def look_up(asked: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(lang, gram, p) of every distinct (lang, gram) asked for, by joins with all orders; the same as KneserNey.probability."""
    out = asked.select("lang", "gram").distinct().withColumn("p", F.lit(FLOOR))
    for n, table in enumerate(tables, 1):
        g = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * n)) - 1)) if n < ORDER else F.col("gram")
        out = out.withColumn("g", g).withColumn("h", F.shiftrightunsigned("g", _BITS))
        out = out.join(table.select("lang", F.col("gram").alias("g"), F.col("p").alias("stored")), ["lang", "g"], "left")
        out = out.join(table.select("lang", F.shiftrightunsigned("gram", _BITS).alias("h"), "left").distinct(), ["lang", "h"], "left")
        out = out.select("lang", "gram", F.coalesce("stored", F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
    return out.withColumn("p", F.greatest("p", F.lit(1e-12)))
