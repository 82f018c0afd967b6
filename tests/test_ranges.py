"""Running sums carried over ranges equal the plain window, whatever the ranges are."""

import pytest
from pyspark.sql import Window, functions as F

from cardwatch.operators.ranges import PART, in_ranges, with_last, with_running


def plain(df, sums, group):
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return sorted(map(tuple, df.select("id", *[F.sum(expr).over(window) for expr in sums.values()]).collect()))


@pytest.mark.parametrize("group", [[], ["key"]])
@pytest.mark.parametrize("range_rows", [37, 5_000])
def test_running_sums(spark, group, range_rows):
    # one key holds most rows, ties in t, null keys and values
    key = F.when(F.col("id") % 5 < 3, 1).when(F.col("id") % 5 == 3, F.col("id") % 11)
    df = spark.range(1_000).select("id", key.alias("key"), (F.col("id") * 7919 % 97).alias("t"), F.when(F.col("id") % 13 > 0, F.col("id")).alias("v"))
    sums = {"rows": F.lit(1), "total": F.coalesce("v", F.lit(0))}
    placed = in_ranges(df, [*group, "t", "id"], ["id", "key", "v"], range_rows)
    assert (placed.select(PART).distinct().count() > 1) == (range_rows == 37)
    running = with_running(placed, sums, group)
    assert sorted(map(tuple, running.select("id", *sums).collect())) == plain(df, sums, group)


@pytest.mark.parametrize("group", [[], ["key"]])
def test_next_value(spark, group):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id") * 2).alias("v"))
    placed = in_ranges(df, [*group, "id"], ["id", "key", "v"], 41)
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("id")
    want = sorted(map(tuple, df.select("id", F.lead("v").over(window)).collect()))
    assert sorted(map(tuple, with_running(placed, {"n": F.lit(1)}, group, {"after": "v"}).select("id", "after").collect())) == want


@pytest.mark.parametrize("range_rows", [41, 5_000])
def test_last_value(spark, range_rows):
    # nulls over many ranges, and at the beginning of a key
    df = spark.range(500).select("id", (F.col("id") % 3).alias("key"), F.when((F.col("id") > 20) & (F.col("id") % 151 < 3), F.col("id") * 2).alias("v"))
    placed = in_ranges(df, ["key", "id"], ["id", "key", "v"], range_rows)
    window = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(tuple, df.select("id", F.coalesce(F.last("v", ignorenulls=True).over(window), F.lit(-1))).collect()))
    found = with_last(placed, "v", "last", ["key"]).select("id", F.coalesce("last", F.lit(-1)))
    assert sorted(map(tuple, found.collect())) == want


def test_no_rows(spark):
    placed = in_ranges(spark.createDataFrame([], "key int, t int"), ["key", "t"], ["key", "t"])
    assert with_running(placed, {"n": F.lit(1)}, ["key"]).collect() == []
    assert with_last(placed, "t", "last", ["key"]).collect() == []
