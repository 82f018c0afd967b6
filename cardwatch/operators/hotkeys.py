"""Keys that hold a large share of the rows, and joins that survive them.

Partial aggregation already makes `groupBy` safe under skew.  A join or a window
on the same key is not: all rows of the key meet in one task.  The helpers here look
for hot keys first.  Where there are none the plain plan is used; where there are,
the rows of those few keys take a way that never shuffles them by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cardwatch.session import durable

# A hot key has more than 1/HOT_SHARE of the rows, so there are fewer than
# HOT_SHARE of them however large the table is: that bounds every broadcast here.
HOT_SHARE = 20_000
HOT_ROWS = 1_000_000


def hot_only(per_key: DataFrame, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of a one-row-per-key table whose key is hot: fewer than HOT_SHARE rows."""
    share = per_key.agg((F.sum(size) / HOT_SHARE).alias("share")).scalar()
    return per_key.filter(F.col(size) > F.greatest(F.lit(float(hot_rows)), share.cast("double")))


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of `df`, ready to broadcast; None when there are none.

    Runs one count over the key column when called, because the answer decides the plan.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    hot = durable(hot_only(sizes, "key_rows", hot_rows).select(key), "hot-keys")
    return None if hot.isEmpty() else F.broadcast(hot)


def split_above(df: DataFrame, key: str, rows: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows of keys with more than `rows` rows or None, all other rows, NULL keys among them).

    Such keys may be many, so they are a stored table whose size decides whether it is broadcast.
    One count over the key column.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    large = durable(sizes.filter(F.col("key_rows") > rows).select(key), "large-keys")
    if large.isEmpty():
        return None, df
    return df.join(large, key, "left_semi").select(*df.columns), df.join(large, key, "left_anti").select(*df.columns)


def split_hot(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot keys or None, all other rows, NULL keys among them); no shuffle."""
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return None, df
    return df.join(hot, key, "left_semi"), df.join(hot, key, "left_anti")


def attach_per_key(df: DataFrame, per_key: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a one-row-per-key table to its rows; a NULL key matches the NULL key.

    `size` is the column of `per_key` that counts the rows of `df` having the key.
    Hot keys are joined map-side; the rest shuffles with no key above the limit.
    """
    side = durable(per_key, "per-key").withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    hot = hot_only(side, size, hot_rows)
    if hot.isEmpty():
        return df.join(side, same).drop("_key")
    cold = side.join(F.broadcast(hot.select(F.col("_key").alias("_hot"))), F.col("_key").eqNullSafe(F.col("_hot")), "left_anti")
    hot_part = df.join(F.broadcast(hot), same).drop("_key")
    cold_part = df.join(F.broadcast(hot.select("_key")), same, "left_anti").join(cold, same).drop("_key")
    return hot_part.unionByName(cold_part)


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str, wanted: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join a one-row-per-key lookup to rows whose keys may be hot."""
    lookup = lookup.select(key, *wanted)
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return df.join(lookup, key, "left")
    hot_part = df.join(hot, key, "left_semi").join(F.broadcast(lookup.join(hot, key, "left_semi")), key, "left")
    return hot_part.unionByName(df.join(hot, key, "left_anti").join(lookup, key, "left"))
