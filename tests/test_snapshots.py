import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import skew, snapshots as s


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(spark, request, monkeypatch):
    """Both ways a join can be planned; the shuffle way also treats every key as hot."""
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(skew, "HOT_ROWS", 0)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, joins, how, rows):
    rnd = random.Random(1)
    probe = spark.createDataFrame(
        [(rnd.choice(["hot"] * 6 + ["a", "b", None, None]), i) for i in range(500)], "k string, n int"
    ).repartition(5)
    lookup = spark.createDataFrame([("hot", "H"), ("a", "A"), ("c", "C"), ("hot", "H2")], "k string, v string")
    assert rows(skew.salted_join(probe, lookup, ["k"], how)) == rows(probe.join(lookup, ["k"], how))


def test_hot_keys_are_spread_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probe = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id").repartition(16)
        lookup = spark.range(-1, 20000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        assert [r[0] for r in skew.hot_keys(probe, ["k"]).rows] == [-1]
        plan = skew.salted_join(probe, lookup, ["k"], "inner")._jdf.queryExecution().optimizedPlan().toString()
        assert skew.SALT in plan
        even = spark.range(20000).select(F.col("id").alias("k"))
        assert not skew.hot_keys(even, ["k"])
        plan = skew.salted_join(even, lookup, ["k"], "inner")._jdf.queryExecution().optimizedPlan().toString()
        assert skew.SALT not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


OLD = [("common", 1, "f"), ("sized", 1, "f"), ("gone", 3, None), ("nulls", None, None)]
NEW = [("common", 1, "f"), ("sized", 2, "f"), ("fresh", 9, None), ("nulls", None, None)]
WANT = [
    ("common", "common", 1, "f"), ("fresh", "added", 9, None), ("gone", "removed", 3, None),
    ("nulls", "common", None, None), ("sized", "modified", 2, "f"),
]


def test_unique_snapshots(spark, joins, rows):
    old, new = (spark.createDataFrame(r, "name string, size int, kind string") for r in (OLD, NEW))
    assert rows(s.snapshot_diff(old, new, ["name"])) == WANT
    assert rows(s.only_in(old, new, ["name"]), "name") == [("gone",)]
    assert rows(s.identical_rows(old, new), "name") == [("common",), ("nulls",)]


def test_duplicates_last_left_row_wins_and_right_rows_stay(spark, joins, rows):
    old = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("y", 1, 5), ("y", 2, 6)], "name string, ord int, size int")
    new = spark.createDataFrame([("x", 1, 20), ("x", 2, 10), ("x", 3, 20)], "name string, ord int, size int")
    got = rows(s.snapshot_diff(old, new, ["name"], ["size"], left_order=["ord"]))
    assert got == [("x", "common", 20), ("x", "common", 20), ("x", "modified", 10), ("y", "removed", 5), ("y", "removed", 6)]


def test_union_fills_missing_columns(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2,)], "n int")
    assert rows(s.union_all([a, b])) == [(1, "x"), (2, None)]
