"""Mixing sources to target weights by Pareto order sampling (problem 9)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.session import cut

#: Where the vocabulary lies for the driver, which reads it and sends it to the workers (about 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that one task puts in order where the sample of a source ends; a class of more is divided again.
EDGE_ROWS = 100_000
#: Classes of document size and of rank a source has in the histograms; they bound what the driver or a broadcast sees.
SIZE_BINS, RANK_BINS = 512, 8192


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of each whole text by a public byte-level BPE vocabulary (a .tiktoken file that the driver can read); 0 for null and empty texts."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary, pattern)
        for s in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return F.pandas_udf(count, "long").asNondeterministic()(text)  # not to be computed again for every filter


def _scale(bins: list[tuple[float, float]], want: float) -> float:
    """c such that the sum of min(1, c * size) * size over bins of (size, tokens) is ``want``."""
    lo, hi = 0.0, 1.0
    reached = lambda c: sum(min(1.0, c * size) * tokens for size, tokens in bins)
    while reached(hi) < want and hi < 1e18:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reached(mid) < want else (lo, mid)
    return hi


def _edges(ranked: DataFrame, rests: dict[str, float]) -> list[tuple[str, float, float, float]]:
    """(source, lowest rank, highest rank, size still wanted) of the class of ranks in which each source's sample ends.

    A histogram of RANK_BINS classes finds it; a class of more than EDGE_ROWS documents is divided into as many again. One
    row a source comes to the driver each time. A source that needs no sample ends before its first document.
    """
    spark = ranked.sparkSession
    done = {s: (s, -1e300, -1e300, 0.0) for s, rest in rests.items() if rest <= 0}
    open_ = {s: (s, -20.0, 20.0, rest) for s, rest in rests.items() if rest > 0}
    first = True
    while open_:
        part = ranked.join(F.broadcast(spark.createDataFrame(list(open_.values()), "s string, lo double, hi double, want double")), "s")
        part = part if first else part.where("rank >= lo and rank <= hi")
        place = F.floor((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANK_BINS)
        per = part.groupBy("s", F.greatest(F.lit(0), F.least(F.lit(RANK_BINS - 1), place)).alias("bin")).agg(F.sum("z").alias("t"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.first("want").alias("want"))
        summed = per.withColumn("before", F.sum("t").over(W.partitionBy("s").orderBy("bin")) - F.col("t")).where("before < want")
        rows = summed.groupBy("s").agg(F.max_by(F.struct("lo", "hi", "n", (F.col("want") - F.col("before")).alias("left")), "bin").alias("e")).select("s", "e.*").collect()
        found = {r["s"]: r for r in rows}
        following = {}
        for s in open_:
            r = found.get(s)
            if r is None:
                done[s] = (s, -1e300, -1e300, 0.0)
            elif r["n"] <= EDGE_ROWS or r["lo"] == r["hi"]:
                done[s] = (s, r["lo"], r["hi"], r["left"])
            else:
                following[s] = (s, r["lo"], r["hi"], r["left"])
        open_, first = following, False
    return list(done.values())


def mix_sources(sizes: DataFrame, doc_id: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 42) -> DataFrame:
    """The documents of the mixture: doc_id, source, copies (1 or more) and size.

    targets: source, target_share, max_repeats; shares are taken relative to their sum. ``total`` is the size of the
    mixture; by default, the largest at which no source needs more than max_repeats copies of a document. With a larger
    one, such a source gives all its documents max_repeats times and falls short. Each source gives as many whole copies of
    all its documents as fit. The rest is a Pareto order sample: inclusion odds grow with the document's size, a document
    ranks by random odds over inclusion odds, and the first in that order are taken until the size is reached. The random
    numbers are a hash of id and seed, so the result doesn't depend on the partitioning.

    Documents of null size, of size 0, with a null source or a source without target are left out, as are null or non-positive
    shares. Repeated rows of one id share a random number, but are documents of their own. Empty tables give an empty mixture.
    No source is ever sorted as a whole: histograms of ranks find the class in which the sample ends, divided until it is small, and only
    that class is put in order.
    """
    spark = sizes.sparkSession
    goal = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy(F.col("source").alias("s")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    docs = sizes.select(F.col(doc_id).alias("d"), F.col(source).alias("s"), F.col(size).cast("double").alias("z"), F.col(size).alias("z0")).where("z > 0 and s is not null")
    # As many rows as there are sources with a target.
    docs = docs.join(F.broadcast(goal.select("s")), "s", "left_semi")
    h = F.xxhash64(F.lit(seed), "d")
    docs = cut(docs.withColumn("u", (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)))
    bins = docs.groupBy("s", F.least(F.lit(SIZE_BINS - 1), F.floor(F.log2("z") * 16)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("tokens")).collect()
    shares = {r["s"]: (r["share"], r["most"]) for r in goal.collect()}
    whole = sum(x for x, _ in shares.values()) or 1.0
    have = {s: sum(b["tokens"] for b in bins if b["s"] == s) for s in shares}
    have = {s: x for s, x in have.items() if x > 0}
    if not have:
        return docs.select(F.col("d").alias(doc_id), F.col("s").alias(source), F.lit(1).alias("copies"), F.col("z0").alias(size)).limit(0)
    if total is None:
        total = min(shares[s][1] * x / (shares[s][0] / whole) for s, x in have.items())
    plan = []
    for s, x in have.items():
        want = min(total * shares[s][0] / whole, shares[s][1] * x)
        copies = int(want / x + 1e-9)
        rest = max(0.0, want - copies * x)
        plan.append((s, copies, rest, _scale([(b["tokens"] / b["n"], b["tokens"]) for b in bins if b["s"] == s], rest) if rest > 0 else 0.0))
    planned = docs.join(F.broadcast(spark.createDataFrame(plan, "s string, whole int, rest double, scale double")), "s")
    odds = F.least(F.col("scale") * F.col("z"), F.lit(1.0))
    # log((u / (1 - u)) / (p / (1 - p))); certain documents rank first, impossible ones last.
    rank = F.when(odds >= 1, F.lit(-1e9)).when(odds <= 0, F.lit(1e9)).otherwise(F.log(F.col("u") / (1 - F.col("u"))) - F.log(odds / (1 - odds)))
    ranked = planned.withColumn("rank", rank)
    edges = _edges(ranked, {s: rest for s, _, rest, _ in plan})
    near = ranked.join(F.broadcast(spark.createDataFrame(edges, "s string, lo double, hi double, left double")), "s")
    sure = near.where("rank < lo or rank > hi").withColumn("taken", F.col("rank") < F.col("lo"))
    inner = W.partitionBy("s").orderBy("rank", "d", "z0").rowsBetween(W.unboundedPreceding, 0)
    last = near.where("rank >= lo and rank <= hi").withColumn("taken", F.sum("z").over(inner) - F.col("z") / 2 <= F.col("left"))
    both = sure.unionByName(last).withColumn("copies", F.col("whole") + F.col("taken").cast("int"))
    return both.where("copies > 0").select(F.col("d").alias(doc_id), F.col("s").alias(source), "copies", F.col("z0").alias(size))


def mixture_shares(mixture: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """For each target source: target_share, actual_share, documents, uses, most_copies and size used."""
    used = mixture.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col(size)).alias("used"))
    joined = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["documents", "uses", "most_copies", "used"])
    everything = F.sum("used").over(W.partitionBy())  # one row a source
    return joined.withColumn("actual_share", F.when(everything > 0, F.col("used") / everything).otherwise(F.lit(0.0)))
