"""Running sums over rows laid out in ranges of a global order.

A window puts all rows of a key, or of the whole table, in one task.  Here the rows are range
partitioned by (key, order) and stored, each range is summed on its own, and the sums of the ranges
before it are carried in.  Cuts come from Spark's own sampling, so nothing of the data stands in the
plan, nothing is collected, and there may be any number of ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.session import durable

RANGE_ROWS = 1_000_000
# in a stored table of `in_ranges`: the range of a row, and its place in the global order
PART, PLACE = "_part", "_place"


def in_ranges(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str], range_rows: int = RANGE_ROWS, label: str = "ranges") -> DataFrame:
    """Columns `keep` of `df`, stored in ascending order of `order`, with `PART` and `PLACE`.

    A range holds about `range_rows` rows.  Rows equal in all of `order` stay in one range: end it with
    something that differs where a table may repeat a row very often.  Runs one count.
    """
    ranges = max(1, -(-df.count() // range_rows))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id holds the partition number above its 33rd bit
    placed = placed.select(*keep, F.monotonically_increasing_id().alias(PLACE))
    return durable(placed.withColumn(PART, F.shiftright(PLACE, 33).cast("int")), label)


def _same(names: Sequence[str], prefix: str) -> Column:
    same = F.col(PART) == F.col(f"{prefix}{PART}")
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return same


def with_running(placed: DataFrame, sums: Mapping[str, Column], group: Sequence[str] = (), following: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the inclusive running sum of each of `sums` in the order of `in_ranges`, per `group`.

    `following` names columns to add that hold the value of another column in the next row of the group, null in the
    last.  `group` names leading columns of the order, so that a group's rows are neighbours: only the first
    group of a range can have begun in an earlier one, and only the last can go on.  What is carried is at
    most two rows a range, and that is what is broadcast.
    """
    group, following = list(group), dict(following or {})
    terms = placed.select(*group, PART, PLACE, *[expr.alias(f"_sum_{name}") for name, expr in sums.items()], *[F.col(of).alias(f"_next_{name}") for name, of in following.items()])
    per_range = terms.groupBy(*group, PART).agg(
        *[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in sums],
        *[F.min_by(f"_next_{name}", PLACE).alias(f"_next_{name}") for name in following],
        F.max(PLACE).alias("_last"),
    )
    # one row per range and group; per group as many as it has ranges
    by_range = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PART)
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select(
        *[F.col(name).alias(f"_of_{name}") for name in (*group, PART)],
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in sums],
        *[F.lead(f"_next_{name}").over(by_range).alias(f"_next_{name}") for name in following],
        "_last",
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        F.lead("_last").over(by_range).alias("_later"),
    ).filter("_earlier > 0 OR _later IS NOT NULL").drop("_earlier", "_later")
    inside = Window.partitionBy(PART, *group).orderBy(PLACE)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*", *[F.sum(expr).over(so_far).alias(f"_local_{name}") for name, expr in sums.items()], *[F.lead(of).over(inside).alias(f"_inside_{name}") for name, of in following.items()]
    )
    joined = local.join(F.broadcast(carried), _same(group, "_of_"), "left")
    return joined.select(
        *placed.columns,
        *[(F.col(f"_local_{name}") + F.coalesce(f"_carry_{name}", F.lit(0))).alias(name) for name in sums],
        *[F.when(F.col(PLACE) == F.col("_last"), F.col(f"_next_{name}")).otherwise(F.col(f"_inside_{name}")).alias(name) for name in following],
    )


def with_last(placed: DataFrame, value: str, name: str, group: Sequence[str]) -> DataFrame:
    """Adds as `name` the last value of `value` that is not null, up to and with the row, in the order of `in_ranges`, per `group`.

    What a range cannot answer itself it takes from the ranges before: at most one row a range.
    """
    group = list(group)
    present = F.when(F.col(value).isNotNull(), F.col(PLACE))
    per_range = placed.groupBy(*group, PART).agg(F.max_by(value, present).alias("_closing"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    opening = per_range.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*group, PART)], F.last("_closing", ignorenulls=True).over(earlier).alias("_opening")
    ).filter(F.col("_opening").isNotNull())
    so_far = Window.partitionBy(PART, *group).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_inside", F.last(value, ignorenulls=True).over(so_far))
    joined = local.join(F.broadcast(opening), _same(group, "_of_"), "left")
    return joined.select(*placed.columns, F.coalesce("_inside", "_opening").alias(name))
