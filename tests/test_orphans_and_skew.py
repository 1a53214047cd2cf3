"""References that do not hold, and joins with hot keys."""

import random
from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from diskloom.operators import orphans as O
from diskloom.operators import skew

CHILD = "id long, disk_id long, image_id long, last_seen timestamp, key string"
PARENT = "id long, added_at timestamp, removed_at timestamp, seen string"
T = D(2020, 5, 1)


def found(spark, child, disks, images=(), **k):
    make = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], PARENT)
    df = O.orphan_references(spark.createDataFrame([(*r, "clash") for r in child], CHILD), {"disks": ("disk_id", make(disks)), "images": ("image_id", make(images))}, **k)
    return df, {tuple(r) for r in df.collect()}


def test_causes(spark):
    disks = [(1, D(2020, 1, 1), None), (2, D(2020, 6, 1), None), (3, D(2020, 1, 1), T), (4, D(2020, 1, 1), D(2020, 5, 2)), (5, None, None), (None, T, None)]
    child = [(10, 1, None, T), (11, 2, 9, T), (12, 3, None, T), (13, 4, None, T), (14, 5, None, T), (15, 99, None, T), (15, 99, None, T), (16, None, None, T), (17, 99, None, None), (18, 2, None, None), (19, 2, None, D(2020, 6, 1))]
    df, got = found(spark, child, disks)
    assert got == {(11, "disks", "2020-05", "late"), (12, "disks", "2020-05", "deleted"), (15, "disks", "2020-05", "missing"), (11, "images", "2020-05", "missing"), (17, "disks", None, "missing")}
    assert df.count() == len(got)
    report = {tuple(r) for r in O.orphan_report(df).collect()}
    assert ("disks", "2020-05", "missing", 1, 1) in report and len(report) == 5


def test_empty_tables(spark):
    assert found(spark, [], [])[1] == set()
    assert found(spark, [(1, 5, None, T)], [])[1] == {(1, "disks", "2020-05", "missing")}


def test_hot_keys_change_nothing(spark):
    rnd = random.Random(1)
    child = [(i, rnd.choice([7, 7, 7, rnd.randrange(40)]), rnd.choice([None, rnd.randrange(9)]), T + timedelta(days=rnd.randrange(-40, 40))) for i in range(600)]
    disks = [(i, T + timedelta(days=rnd.randrange(-30, 30)), rnd.choice([None, T + timedelta(days=rnd.randrange(-30, 30))])) for i in range(30)]
    life = {i: (a, r) for i, a, r in disks}
    want = set()
    for i, d, m, seen in child:
        for name, key in (("disks", d), ("images", m)):
            if key is None:
                continue
            a, r = life.get(key, (None, None)) if name == "disks" else (None, None)
            cause = "missing" if name == "images" or key not in life else "late" if a > seen else "deleted" if r and r <= seen else None
            if cause:
                want.add((i, name, seen.strftime("%Y-%m"), cause))
    assert found(spark, child, disks)[1] == want == found(spark, child, disks, hot_rows=50)[1]


def test_a_third_of_all_rows_under_one_key_that_holds(spark):
    child = [(i, 1 if i % 3 == 0 else 1000 + i, None, T) for i in range(900)]
    disks = [(1, D(2020, 1, 1), None)] + [(1000 + i, D(2020, 1, 1), None) for i in range(0, 900, 2)]
    plain, split = found(spark, child, disks)[1], found(spark, child, disks, hot_rows=100)[1]
    assert plain == split == {(i, "disks", "2020-05", "missing") for i in range(900) if i % 3 and i % 2}


def test_lookup_join(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)] + [(999, None)], "i long, k long")
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 300, 3)] + [(1, 2)], "k long, v long")
    plain = {tuple(r) for r in left.join(right, "k", "left").collect()}
    assert {tuple(r) for r in skew.lookup_join(left, right, "k").collect()} == plain == {tuple(r) for r in skew.lookup_join(left, right, "k", least_rows=20).select("k", "i", "v").collect()}
    assert skew.lookup_join(left, right, "k", "inner", least_rows=20).count() == sum(r[2] is not None for r in plain)
    assert skew.hot_keys(left, "k", 20) == [1] and skew.hot_keys(left, "k") == [] and skew.lookup_join(left.limit(0), right, "k").count() == 0


def test_no_shuffle_of_all_columns(spark, tmp_path):
    """The plan reads three columns of the child and filters NULL keys at the scan."""
    spark.createDataFrame([(1, 1, None, T, "x")], CHILD).write.parquet(str(tmp_path / "c"))
    child = spark.read.parquet(str(tmp_path / "c"))
    parent = spark.createDataFrame([(1, T, None, "x")], PARENT)
    plan = O.orphan_references(child, {"disks": ("disk_id", parent)})._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,disk_id:bigint,last_seen:timestamp>" in plan and "IsNotNull(disk_id)" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_null_names_in_clashing_columns(spark):
    df, got = found(spark, [(1, 2, 3, T)], [(2, T, None)], [(3, T, None)])
    assert got == set() and df.select(F.count("*")).first()[0] == 0
