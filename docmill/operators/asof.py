"""Attributes as known at event time: a bitemporal as-of join by co-grouping and binary search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events and changes together that a task should get. A key with more is hot: its time is divided into ranges.
ROWS_PER_GROUP = 200_000
#: Ranges that the time of one hot key is divided into at most; beyond them ranges grow, and events are salted.
MAX_RANGES = 1024
EARLIEST, NEVER = -(1 << 63), (1 << 63) - 1


def latest_valid(e_key: np.ndarray, e_at: np.ndarray, c_key: np.ndarray, c_from: np.ndarray, c_to: np.ndarray, c_known: np.ndarray) -> np.ndarray:
    """Of each event, the position of its change, or -1.

    Changes are sorted by (key, preference), so the greatest position among those in force is wanted. A change is in force from
    the later of ``from`` and ``known`` until before ``to``. These intervals are spread over a tree on the borders of all
    intervals, in log(n) steps for all changes at once; a binary search finds each event's place between the borders, and
    the way from there to the root its best change. However many versions have ended before, the steps stay the same.
    """
    none = np.full(len(e_key), -1, dtype=np.int64)
    start = np.maximum(c_from, c_known)
    valid = np.flatnonzero(start < c_to)
    if not len(valid) or not len(e_key):
        return none
    # One integer orders (key, time): ranks of the times stand for the times.
    times = np.unique(np.concatenate([start[valid], c_to[valid]]))
    at = lambda key, t, side: key * (len(times) + 1) + np.searchsorted(times, t, side)
    lo, hi = at(c_key[valid], start[valid], "right"), at(c_key[valid], c_to[valid], "right")
    borders = np.unique(np.concatenate([lo, hi]))
    size = 1 << int(len(borders) - 1).bit_length()
    best = np.full(2 * size, -1, dtype=np.int64)
    a, b = np.searchsorted(borders, lo) + size, np.searchsorted(borders, hi) + size
    while True:
        open_ = a < b
        if not open_.any():
            break
        a, b, valid = a[open_], b[open_], valid[open_]
        left, right = (a & 1) == 1, (b & 1) == 1
        np.maximum.at(best, a[left], valid[left])
        np.maximum.at(best, b[right] - 1, valid[right])
        a, b = (a + left) >> 1, (b - right) >> 1
    place = np.searchsorted(borders, at(e_key, e_at, "right"), "right") - 1
    inside = np.flatnonzero(place >= 0)
    node = place[inside] + size
    while len(node) and node[0] > 0:
        none[inside] = np.maximum(none[inside], best[node])
        node >>= 1
    return none


def _search(e_type: str, c_type: str, ranks: list[str]):
    def search(_: tuple, ev: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
        if not len(ev) or not len(ch):
            return pd.DataFrame({"e": ev["e"].iloc[:0], "c": ch["c"].iloc[:0]})
        codes, _ = pd.factorize(pd.concat([ch["k"], ev["k"]], ignore_index=True))
        ch = ch.assign(k=codes[: len(ch)]).sort_values(["k", "f", *ranks, "c"], ascending=[True, True, *[True] * len(ranks), False], kind="stable")
        long = lambda s: s.to_numpy(dtype="int64")  # noqa: E731  no nulls: Spark has filled them, so no value passes through a float
        pos = latest_valid(codes[len(ch) :].astype("int64"), long(ev["at"]), long(ch["k"]), long(ch["f"]), long(ch["t"]), long(ch["r"]))
        hit = pos >= 0
        return pd.DataFrame({"e": ev["e"].to_numpy()[hit], "c": ch["c"].to_numpy()[pos[hit]]})

    return search, f"e {e_type}, c {c_type}"


def _range_of(time: Column, cuts: Column) -> Column:
    """The number of cuts at or before a time; 0 without cuts."""
    return F.coalesce(F.size(F.filter(cuts, lambda x: x <= time)), F.lit(0))


def asof_valid(
    events: DataFrame,
    changes: DataFrame,
    key: str,
    event_id: str,
    event_at: str,
    change_id: str,
    valid_from: str,
    valid_to: str | None = None,
    known_from: str | None = None,
    prefer: Sequence[str] = (),
) -> DataFrame:
    """Each event with the one change of its entity that was valid and recorded by the event's time.

    Times are integers of one unit, and stay 64-bit integers throughout. A change counts for an event if ``valid_from`` <= time,
    ``valid_to`` is null or > time, and ``known_from`` is null or <= time. Of several, the one with the latest
    ``valid_from`` is taken, then the greatest of the ``prefer`` columns in turn (nulls last), then the smallest
    ``change_id``. Returns (event_id, change_id), event_id and change_id as given; events without such a
    change don't appear.

    Null keys, null times and changes with a null ``valid_from`` never match. Repeated events each come out;
    repeated changes change nothing. Empty tables give no rows. Other columns are ignored. The greatest long stands for
    "never ends" and the least for "always known".

    Rows are co-grouped by a hash bucket of the entity. A hot entity (more than ROWS_PER_GROUP rows) has groups of
    its own, one for each range of its time; ranges follow the quantiles of its events and changes. A change goes to every range it
    may decide: from its own to the one in which it ends, or in which the next version of the entity, which then
    covers it, begins. Events of one range beyond the bound, as at one moment, are salted by a hash of id and time, so that a
    recomputed task gives the same split.
    """
    spark = events.sparkSession
    e = events.select(F.col(key).cast("string").alias("k"), F.col(event_id).alias("e"), F.col(event_at).cast("long").alias("at")).where("k is not null and at is not null")
    filled = lambda c, default: F.coalesce(F.col(c).cast("long"), F.lit(default)) if c else F.lit(default)
    ranks = [f"p{i}" for i in range(len(prefer))]
    c = changes.select(
        F.col(key).cast("string").alias("k"), F.col(change_id).alias("c"), F.col(valid_from).cast("long").alias("f"), filled(valid_to, NEVER).alias("t"), filled(known_from, EARLIEST).alias("r"),
        *[filled(p, EARLIEST).alias(n) for p, n in zip(prefer, ranks)],
    ).where("k is not null and f is not null")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
    times = e.select("k", F.col("at").alias("x")).unionByName(c.select("k", F.col("f").alias("x")))
    # At most one row for every ROWS_PER_GROUP rows of input; each has at most MAX_RANGES longs.
    sizes = times.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_GROUP)
    hot = {r["k"]: -(-r["n"] // ROWS_PER_GROUP) for r in sizes.collect()}
    search, schema = _search(events.schema[event_id].dataType.simpleString(), changes.schema[change_id].dataType.simpleString(), ranks)
    if not hot:
        e, c = e.withColumn("b", bucket), c.withColumn("b", bucket)
        found = e.groupBy("b").cogroup(c.groupBy("b")).applyInPandas(search, schema)
        return found.select(F.col("e").alias(event_id), F.col("c").alias(change_id))

    wanted = F.broadcast(spark.createDataFrame([(k, min(MAX_RANGES, n)) for k, n in hot.items()], "k string, ranges int"))
    points = times.join(wanted, "k").groupBy("k", "ranges").agg(F.percentile_approx("x", F.array(*[F.lit(i / MAX_RANGES) for i in range(1, MAX_RANGES)]), 4 * MAX_RANGES).alias("q"))
    picked = F.transform(F.sequence(F.lit(1), F.col("ranges") - 1), lambda i: F.get("q", (i * F.lit(MAX_RANGES) / F.col("ranges")).cast("int") - 1))
    rows = points.select("k", F.array_sort(F.array_distinct(F.when(F.col("ranges") > 1, picked).otherwise(F.array().cast("array<bigint>")))).alias("cuts")).collect()
    cuts = F.broadcast(spark.createDataFrame([(r["k"], r["cuts"]) for r in rows], "k string, cuts array<bigint>"))
    # Hot keys have groups of their own: the bucket is negative, and the key itself parts them.
    own = F.when(F.col("cuts").isNotNull(), -1 - bucket).otherwise(bucket)
    e = e.join(cuts, "k", "left").withColumn("b", own).withColumn("g", F.when(F.col("cuts").isNotNull(), F.col("k")).otherwise("")).withColumn("n", _range_of(F.col("at"), F.col("cuts"))).drop("cuts")
    c = c.join(cuts, "k", "left").withColumn("b", own).withColumn("g", F.when(F.col("cuts").isNotNull(), F.col("k")).otherwise("")).withColumn("n", _range_of(F.col("f"), F.col("cuts")))
    # The next version of the entity in the same range covers this one if it ends no earlier and is known when it begins.
    order = W.partitionBy("b", "g", "n", "k").orderBy("f", *ranks, F.col("c").desc())
    ahead = F.lead(F.struct("f", "t", "r")).over(order)
    calm, busy = c.where("cuts is null").withColumn("last", F.col("n")), c.where("cuts is not null").withColumn("next", ahead)
    covered = F.coalesce((F.col("next.t") >= F.col("t")) & (F.col("next.r") <= F.greatest("next.f", "r")), F.lit(False))
    busy = busy.withColumn("last", F.when(covered, F.col("n")).otherwise(_range_of(F.when(F.col("t") == EARLIEST, F.col("t")).otherwise(F.col("t") - 1), F.col("cuts"))))
    # The first version of each later range limits how far the last one of this range reaches, if it covers it.
    firsts = busy.groupBy("b", "g", "n").agg(F.max_by(F.struct("f", "t", "r"), F.struct("t", F.bitwise_not("r").alias("early"))).alias("top"))
    spread_to = busy.join(firsts.select("b", "g", (F.col("n") - 1).alias("n"), F.col("top").alias("over")), ["b", "g", "n"], "left")
    stops = F.coalesce((F.col("over.t") >= F.col("t")) & (F.col("over.r") <= F.greatest("over.f", "r")), F.lit(False))
    spread_to = spread_to.withColumn("last", F.when(stops, F.least("last", F.col("n") + 1)).otherwise(F.col("last"))).drop("over")
    columns = ["k", "c", "f", "t", "r", *ranks, "b", "g"]
    c = calm.select(*columns, "n").unionByName(spread_to.select(*columns, F.explode(F.sequence("n", F.greatest("n", "last"))).alias("n")))
    # One row for each range of a hot key.
    salts = F.broadcast(e.where("g <> ''").groupBy("b", "g", "n").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * ROWS_PER_GROUP)).cast("int").alias("salts")))
    many = F.coalesce("salts", F.lit(1))
    e = e.join(salts, ["b", "g", "n"], "left").withColumn("s", F.pmod(F.xxhash64("e", "at"), many).cast("int")).drop("salts")
    c = c.join(salts, ["b", "g", "n"], "left").withColumn("s", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    group = ["b", "g", "n", "s"]
    found = e.groupBy(*group).cogroup(c.groupBy(*group)).applyInPandas(search, schema)
    return found.select(F.col("e").alias(event_id), F.col("c").alias(change_id))
