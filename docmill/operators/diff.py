"""Differences between two copies of a table, by a column-by-bucket checksum matrix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut

#: Key buckets of the matrix, and so its rows, whatever the tables' size. Within unequal buckets keys are told apart by their own hashes.
BUCKETS = 1 << 12
#: Unequal keys that are broadcast (up to 8 + 16 a field bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_LOW = 0xFFFFFFFF


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _value(name: str) -> Column:
    """The value compared: as string, without leading and trailing U+0020, null as the empty string."""
    return F.coalesce(F.trim(_q(name).cast("string")), F.lit(""))


def _identity(keys: Sequence[str]) -> list[Column]:
    """96 bits that stand for the key; a null is hashed as a marker of its own, since hashes skip nulls."""
    parts = [c for k in keys for c in (_q(k), F.isnull(_q(k)))]
    return [F.xxhash64(*parts).alias("id"), F.hash(*parts).alias("id2")]


def row_hashes(df: DataFrame, keys: Sequence[str], fields: Sequence[str], latest: str | None = None, unique_keys: bool = False) -> DataFrame:
    """(id, id2, at, h0, h1, ...): one row a key with a 64-bit hash of each field's value; no text is shuffled.

    Of a key's rows the latest stands, of equal times the one with the greatest hashes. Repeated rows combine before
    the shuffle, so a key with many costs one row a task. With unique_keys nothing is shuffled at all.
    """
    hashes = [F.xxhash64(F.lit(i), _value(f)).alias(f"h{i}") for i, f in enumerate(fields)]
    narrow = df.select(*_identity(keys), (_q(latest) if latest else F.lit(0)).alias("at"), *hashes)
    if unique_keys:
        return narrow
    one = narrow.groupBy("id", "id2").agg(F.max(F.struct("at", *[f"h{i}" for i in range(len(fields))])).alias("row"))
    return one.select("id", "id2", "row.*")


def _bucket(buckets: int) -> Column:
    return F.pmod("id", F.lit(buckets)).cast("int")


def checksum_matrix(hashed: DataFrame, n_fields: int, buckets: int) -> DataFrame:
    """One row a bucket: the number of keys and their checksums, and for each field two additive sums of key-dependent hashes.

    Halves of 32 bits can be added for 2^31 keys a bucket before a long wraps.
    """
    sums = []
    for i in range(n_fields):
        h = F.xxhash64("id", "id2", f"h{i}")
        sums += [F.sum(h.bitwiseAND(F.lit(_LOW))).alias(f"a{i}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"b{i}")]
    return hashed.groupBy(_bucket(buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("id").alias("s1"), F.sum(F.col("id2").cast("long")).alias("s2"), *sums)


def unequal_cells(left: DataFrame, right: DataFrame, n_fields: int) -> DataFrame:
    """(bucket, mask) of the buckets with an unequal cell: a bit for each unequal field, and the next one for the keys."""
    both = left.alias("l").join(right.alias("r"), "bucket", "full_outer")
    unequal = lambda names: reduce(lambda x, y: x | y, [~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    bits = [F.when(unequal([f"a{i}", f"b{i}"]), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n_fields)]
    bits.append(F.when(unequal(["n", "s1", "s2"]), F.lit(1 << n_fields)).otherwise(F.lit(0)))
    return both.select("bucket", reduce(lambda x, y: x.bitwiseOR(y), bits).cast("long").alias("mask")).where("mask <> 0")


def _unequal_keys(a: DataFrame, b: DataFrame, n: int, buckets: int) -> DataFrame:
    """Keys that one side lacks, or whose hashes differ in a field unequal in their bucket: id, id2, in_main, in_copy, mask, and both sides' hashes."""
    found = F.broadcast(unequal_cells(checksum_matrix(a, n, buckets), checksum_matrix(b, n, buckets), n))  # at most `buckets` rows
    side = lambda df, s: df.withColumn("bucket", _bucket(buckets)).join(found, "bucket").select("id", "id2", F.col("mask").alias(f"{s}_cells"), *[F.col(f"h{i}").alias(f"{s}{i}") for i in range(n)])
    both = side(a, "m").join(side(b, "c"), ["id", "id2"], "full_outer")
    in_main, in_copy = F.col("m_cells").isNotNull(), F.col("c_cells").isNotNull()
    differs = lambda i: in_main & in_copy & (F.col("m_cells").bitwiseAND(F.lit(1 << i)) != 0) & (F.col(f"m{i}") != F.col(f"c{i}"))
    mask = reduce(lambda x, y: x + y, [F.when(differs(i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n)])
    return both.select("id", "id2", in_main.alias("in_main"), in_copy.alias("in_copy"), mask.cast("long").alias("mask"), *[f"{s}{i}" for s in "mc" for i in range(n)]).where("not in_main or not in_copy or mask <> 0")


def table_diff(
    main: DataFrame,
    copy: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    main_latest: str | None = None,
    copy_latest: str | None = None,
    buckets: int = BUCKETS,
    unique_keys: bool = False,
) -> DataFrame:
    """Rows that one side lacks and fields that differ: keys, ``diff``, ``main_value`` and ``copy_value``.

    diff is ``only_main``, ``only_copy`` (both values null) or the name of the differing field, one row for each. Both sides are
    reduced to a matrix of additive checksums by key bucket and field. Within buckets that have an unequal cell the hashes of
    single keys are compared, for the unequal fields only; then the keys that differ, and of the fields only those that
    differ somewhere, are read again and joined. The matrix has the same bounded size whatever the tables'.

    Null keys are keys of their own (null equals null). A null value equals the empty string, and leading and
    trailing spaces (U+0020) are ignored. Repeated rows of a key count once: the one with the greatest
    ``*_latest``, among equal times the one with the greatest hashes. Where keys are known to be unique,
    ``unique_keys`` spares the shuffle of the row hashes for the matrix. Empty tables give the other side's rows; two empty tables
    give none. Other columns are ignored. At most 62 fields.
    """
    n = len(fields)
    a, b = row_hashes(main, keys, fields, main_latest, unique_keys), row_hashes(copy, keys, fields, copy_latest, unique_keys)
    unequal = cut(_unequal_keys(a, b, n, buckets))
    count, any_mask = unequal.agg(F.count(F.lit(1)), F.coalesce(F.bit_or("mask"), F.lit(0))).head()
    used = [i for i in range(n) if any_mask >> i & 1]
    wanted = unequal.select("id", "id2", "in_main", "in_copy", "mask", *[f"{s}{i}" for s in "mc" for i in used])

    def again(df: DataFrame, s: str) -> DataFrame:
        """The rows that stand for the unequal keys, by their hashes; a row of another time with the same values is as good."""
        rows = df.select(*_identity(keys), *[_q(k).alias(f"k{i}") for i, k in enumerate(keys)], *[_value(fields[i]).alias(f"f{i}") for i in used])
        hit = rows.join(F.broadcast(wanted) if count <= BROADCAST_KEYS else wanted, ["id", "id2"])
        same = [F.xxhash64(F.lit(i), F.col(f"f{i}")) == F.col(f"{s}{i}") for i in used]
        hit = hit.where(reduce(lambda x, y: x & y, same, F.col("in_main" if s == "m" else "in_copy")))
        return hit.select("id", "id2", "in_main", "in_copy", F.struct(*[f"k{i}" for i in range(len(keys))]).alias("k"), F.struct(F.lit(0).alias("z"), *[f"f{i}" for i in used]).alias("v"), F.lit(s).alias("side"))

    rows = again(main, "m").unionByName(again(copy, "c"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("v"))).alias(s)
    joined = rows.groupBy("id", "id2", "in_main", "in_copy").agg(F.max("k").alias("k"), of("m"), of("c"))
    text = lambda c: c.cast("string")
    entry = lambda kind, x, y: F.struct(F.lit(kind).alias("diff"), text(x).alias("x"), text(y).alias("y"))
    null = F.lit(None)
    kinds = F.array_compact(F.array(F.when(~F.col("in_copy"), entry("only_main", null, null)), F.when(~F.col("in_main"), entry("only_copy", null, null)), *[F.when(F.col("in_main") & F.col("in_copy") & (F.col(f"m.f{i}") != F.col(f"c.f{i}")), entry(fields[i], F.col(f"m.f{i}"), F.col(f"c.f{i}"))) for i in used]))
    out = joined.select("k", F.explode(kinds).alias("d"))
    new = {}
    for name in ("diff", "main_value", "copy_value"):
        new[name] = name
        while new[name].lower() in {k.lower() for k in keys}:
            new[name] = "_" + new[name]
    return out.select(*[F.col(f"k.k{i}").alias(k) for i, k in enumerate(keys)], F.col("d.diff").alias(new["diff"]), F.col("d.x").alias(new["main_value"]), F.col("d.y").alias(new["copy_value"]))
