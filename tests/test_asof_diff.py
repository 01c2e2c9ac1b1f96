import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import asof, diff
from docmill.operators.asof import asof_valid
from docmill.operators.diff import table_diff


#: Nanoseconds of a day in 2024, beyond what a float holds exactly.
BASE = 1_706_000_000_123_456_789


def _brute(events, changes):
    out = set()
    for key, e, at in events:
        if key is None or at is None:
            continue
        ok = [c for c in changes if c[0] == key and c[2] is not None and c[2] <= at and (c[3] is None or c[3] > at) and (c[4] is None or c[4] <= at)]
        if ok:
            out.add((e, max(ok, key=lambda c: (c[2], c[5] if c[5] is not None else -(10**9), -c[1]))[1]))
    return out


def _run(spark, events, changes):
    e = spark.createDataFrame(events, "entity string, event_id long, at long").withColumn("c", F.lit("clash")).withColumn("b", F.lit(1))
    c = spark.createDataFrame(changes, "entity string, change_id long, f long, t long, k long, v long").withColumn("s", F.lit(1))
    return {tuple(r) for r in asof_valid(e, c, "entity", "event_id", "at", "change_id", "f", "t", "k", ["v"]).collect()}


@pytest.mark.parametrize("ends", ["mixed", "never", "contiguous"])
def test_asof_equals_brute_force_with_hot_keys_in_ranges(spark, monkeypatch, ends):
    monkeypatch.setattr(asof, "ROWS_PER_GROUP", 25)
    r = random.Random(len(ends))
    maybe = lambda x: None if r.random() < 0.1 else x
    events = [(maybe("hot" if r.random() < 0.5 else f"k{r.randrange(12)}"), i, maybe(BASE + (7 if r.random() < 0.2 else r.randrange(60)))) for i in range(500)]
    changes = []
    for i in range(200):
        f = r.randrange(60)
        t = {"mixed": maybe(BASE + r.randrange(80)), "never": None, "contiguous": BASE + f + r.randrange(1, 3)}[ends]
        changes.append((maybe("hot" if r.random() < 0.5 else f"k{r.randrange(12)}"), i, maybe(BASE + f), t, maybe(BASE + r.randrange(60)) if ends == "mixed" else None, maybe(r.randrange(3))))
    assert _run(spark, events, changes + changes[:5]) == _brute(events, changes)


def test_many_ended_versions_cost_no_pass_each():
    n = 1_000_000
    f = np.arange(n, dtype=np.int64) + BASE
    t = f + 1
    t[0] = asof.NEVER  # only the oldest version is still in force
    zero = np.zeros(n, dtype=np.int64)
    got = asof.latest_valid(zero[:3], np.array([BASE + 2 * n, BASE + 5, BASE - 1]), zero, f, t, np.full(n, asof.EARLIEST))
    assert got.tolist() == [0, 5, -1]


def test_nanoseconds_stay_exact(spark):
    changes = [("a", 1, BASE, BASE + 1001, None, None), ("a", 2, BASE - 5, None, None, None)]
    assert _run(spark, [("a", 10, BASE + 1000), ("a", 11, BASE + 1001)], changes) == {(10, 1), (11, 2)}


def test_asof_never_uses_later_knowledge(spark):
    changes = [("a", 1, 0, None, 0, None), ("a", 2, 5, None, 9, None)]
    assert _run(spark, [("a", 10, 7), ("a", 11, 9)], changes) == {(10, 1), (11, 2)}


def test_asof_empty_sides(spark):
    assert _run(spark, [], [("a", 1, 0, None, None, None)]) == set()
    assert _run(spark, [("a", 1, 0)], []) == set()


def _brute_diff(a, b, fields):
    def one(rows):
        best = {}
        for k, at, *v in rows:
            v = tuple((x or "").strip(" ") for x in v)
            if k not in best or at > best[k][0]:
                best[k] = (at, v)
        return {k: v for k, (_, v) in best.items()}

    x, y = one(a), one(b)
    out = {(k, "only_main") for k in x.keys() - y.keys()} | {(k, "only_copy") for k in y.keys() - x.keys()}
    return out | {(k, f) for k in x.keys() & y.keys() for f, p, q in zip(fields, x[k], y[k]) if p != q}


def test_diff_equals_brute_force(spark):
    r = random.Random(2)
    val = lambda: r.choice([None, "", " ", "x", "x ", "y", "长" * 50, "ｘ"])
    rows = lambda base: [(None if r.random() < 0.02 else f"k{r.randrange(120)}", base + i, val(), val()) for i in range(200)]
    a, b = rows(0), rows(1000)
    schema = "id string, at long, f string, bucket string"
    got = table_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["id"], ["f", "bucket"], "at", "at", buckets=16)
    assert sorted(map(str, {tuple(x)[:2] for x in got.collect()})) == sorted(map(str, _brute_diff(a, b, ["f", "bucket"])))
    assert all((x["main_value"] is None) == x["diff"].startswith("only_") and (x["main_value"] is None or x["main_value"] != x["copy_value"]) for x in got.collect())


@pytest.mark.parametrize("many", [False, True])
def test_unique_keys_and_many_unequal_keys(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(diff, "BROADCAST_KEYS", 1)
    a = [(f"k{i}", i, "x", str(i), "same") for i in range(100)]
    b = [(f"k{i}", i, "x" if i % 7 else "y", str(i), "same") for i in range(5, 103)]
    schema = "diff string, n int, f string, g string, h string"
    got = table_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["diff", "n"], ["f", "g", "h"], unique_keys=True, buckets=32)
    want = {(f"k{i}", "only_main") for i in range(5)} | {(f"k{i}", "only_copy") for i in range(100, 103)} | {(f"k{i}", "f") for i in range(5, 100) if i % 7 == 0}
    assert {(x["diff"], x["_diff"]) for x in got.collect()} == want and got.count() == len(want)


def test_second_read_has_only_keys_and_unequal_fields(spark, tmp_path):
    a = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("same"), F.col("id").cast("string").alias("other"), F.lit("long text").alias("z"))
    a.write.parquet(str(tmp_path / "a"))
    a.withColumn("other", F.when(F.col("k") == 7, "changed").otherwise(F.col("other"))).write.parquet(str(tmp_path / "b"))
    got = table_diff(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")), ["k"], ["same", "other"])
    assert [tuple(x) for x in got.collect()] == [(7, "other", "7", "changed")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    schemas = [x.split("ReadSchema: ")[1].split("\n")[0] for x in plan.split("FileScan")[1:] if "other:" in x.split("ReadSchema: ")[1].split("\n")[0]]
    assert schemas and all("same" not in x and "z:" not in x for x in schemas)


def test_cuts_can_be_dropped(spark):
    from docmill.session import cut, drop_cuts

    drop_cuts(spark)
    assert cut(spark.range(3)).count() == 3 and drop_cuts(spark) == 1 and drop_cuts(spark) == 0


def test_diff_of_equal_and_empty_tables(spark):
    schema = "id string, n int, v string"
    full, empty = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", None, None)], schema), spark.createDataFrame([], schema)
    assert table_diff(full, full, ["id", "n"], ["v"]).count() == 0
    assert table_diff(empty, empty, ["id", "n"], ["v"]).count() == 0
    assert sorted((x["id"], x["diff"]) for x in table_diff(empty, full, ["id", "n"], ["v"]).collect()) == [("a", "only_copy"), ("b", "only_copy")]
