"""Exact, repeatable sampling, rebalancing, splits and folds.

A row's place in a sample is decided by a hash of its key and a seed, so the same
rows come back on every run and after every lost executor.  Picking the n smallest
hashes per class never sorts a class in one task: hashes are counted per slot, only
the one slot that straddles the limit is ranked, and that from keys alone.  What is
left of a draw is one limit a class, so a sample is its source behind one filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.session import durable

LABEL, KEY, SEED = "is_fraud", "trans_num", 42
# 65 536 slots per class bound both the counting table and, evenly spread, the rows
# ranked together: a 65 536th of the class.
SLOT_BITS = 16
COPIES_PER_CHUNK = 100_000
# A table of one row a class is broadcast up to so many classes.
MANY_CLASSES = 100_000


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    draw = F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn("_draw", draw).withColumn("_slot", F.shiftrightunsigned("_draw", 64 - SLOT_BITS).cast("int"))


def _slots(hashed: DataFrame, by: str) -> DataFrame:
    """Rows before and in each hash slot of a class, and in the whole class."""
    counts = hashed.groupBy(by, "_slot").agg(F.count(F.lit(1)).alias("_in_slot"))
    whole = Window.partitionBy(by)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        F.col(by).alias("_class"),
        F.col("_slot").alias("_class_slot"),
        "_in_slot",
        F.coalesce(F.sum("_in_slot").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_slot").over(whole).alias("_class_rows"),
    )


def _with_slots(hashed: DataFrame, slots: DataFrame, by: str) -> DataFrame:
    # bounded by classes x 2^16 rows
    same = F.col(by).eqNullSafe(F.col("_class")) & (F.col("_slot") == F.col("_class_slot"))
    return hashed.join(F.broadcast(slots), same)


def hash_rank(df: DataFrame, by: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Add `draw_rank` (1..n within the class, in hash order) and `class_rows`."""
    hashed = _hashed(df, key, seed)
    placed = _with_slots(hashed, _slots(hashed, by), by)
    in_slot = Window.partitionBy("_class", "_slot").orderBy("_draw", key)
    return placed.withColumn("draw_rank", F.col("_before") + F.row_number().over(in_slot)).select(
        *df.columns, "draw_rank", F.col("_class_rows").alias("class_rows")
    )


@dataclass(frozen=True)
class Draw:
    """The last row that each class of a source gives, in (slot, draw, key) order; a class that gives none is not there."""

    limits: DataFrame
    by: str
    key: str
    seed: int
    few: bool

    def apply(self, df: DataFrame, negate: bool = False) -> DataFrame:
        """The drawn rows of `df`, or (negate) the others: one scan, no shuffle."""
        key, last = F.col(self.key), F.col("_last_key")
        at_draw = F.coalesce(key <= last, key.isNull())
        in_slot = (F.col("_draw") < F.col("_last_draw")) | ((F.col("_draw") == F.col("_last_draw")) & at_draw)
        drawn = (F.col("_slot") < F.col("_last_slot")) | ((F.col("_slot") == F.col("_last_slot")) & in_slot)
        limits = F.broadcast(self.limits) if self.few else self.limits
        rows = _hashed(df, self.key, self.seed).join(limits, F.col(self.by).eqNullSafe(F.col("_class")), "left" if negate else "inner")
        return rows.filter(~F.coalesce(drawn, F.lit(False)) if negate else drawn).select(*df.columns)


def class_slots(df: DataFrame, by: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Rows per hash slot of each class, counted once and stored: at most classes x 2^16 rows."""
    return durable(_slots(_hashed(df.select(by, key), key, seed), by), "slots")


def rows_of_class(slots: DataFrame, value: int) -> Column:
    """Rows of a class, from its slots; 0 for a class that is not there."""
    return slots.agg(F.coalesce(F.sum(F.when(F.col("_class") == value, F.col("_in_slot"))), F.lit(0)).alias("n")).scalar()


def draw_per_class(
    df: DataFrame, quota: Column | Callable[[DataFrame], Column], by: str = LABEL, key: str = KEY, seed: int = SEED, slots: DataFrame | None = None
) -> Draw:
    """The draw of the `quota` rows of each class with the smallest hashes.

    `quota` may use `_class` and `_class_rows`, and as a function the stored slots of all classes.  A quota above the rows
    of a class takes them all; one of null or not above 0 takes none.  Two jobs read class and key of `df`: one counts rows
    per slot, one ranks the slot a class in which its quota falls.  Keys tell rows apart: rows of one key and class are drawn together.
    """
    slots = class_slots(df, by, key, seed) if slots is None else slots
    wanted = F.least((quota(slots) if callable(quota) else quota).cast("bigint"), F.col("_class_rows"))
    place = wanted - F.col("_before")
    edges = slots.filter((place > 0) & (place <= F.col("_in_slot"))).select("_class", F.col("_class_slot").alias("_last_slot"), place.alias("_place"))
    edges = durable(edges, "edges")
    few = edges.count() <= MANY_CLASSES
    same = F.col(by).eqNullSafe(F.col("_class")) & (F.col("_slot") == F.col("_last_slot"))
    rows = _hashed(df.select(by, key), key, seed).join(F.broadcast(edges) if few else edges, same)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy("_draw", key)))
    last = ranked.filter(F.col("_rank") == F.col("_place")).select("_class", "_last_slot", F.col("_draw").alias("_last_draw"), F.col(key).alias("_last_key"))
    return Draw(durable(last, "limits"), by, key, seed, few)


def take_per_class(
    df: DataFrame, quota: Column | Callable[[DataFrame], Column], by: str = LABEL, key: str = KEY, seed: int = SEED, negate: bool = False
) -> DataFrame:
    """The `quota` rows of each class with the smallest draws, or (negate) the others; see `draw_per_class`."""
    return draw_per_class(df, quota, by, key, seed).apply(df, negate)


def sample_n(df: DataFrame, n: int, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Exactly n rows (all of them when there are fewer), the same ones every time."""
    return take_per_class(df.withColumn("_all", F.lit(0)), F.lit(n), "_all", key, seed).drop("_all")


def class_count(df: DataFrame, value: int, label: str = LABEL) -> Column:
    return df.agg(F.count(F.when(F.col(label) == value, 1)).alias("n")).scalar()


def rebalance(df: DataFrame, ratio: float, label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Thin out class 0 until class 1 makes up `ratio` of the rows.

    Nothing changes for a ratio outside (0, 1), or when class 0 is already small enough.
    """
    if not 0.0 < ratio < 1.0:
        return df

    def quota(slots: DataFrame) -> Column:
        wanted = F.floor(rows_of_class(slots, 1) * F.lit(1.0 / ratio - 1.0))
        return F.when(F.col("_class") == 1, F.col("_class_rows")).when(F.col("_class") == 0, wanted)

    return take_per_class(df, quota, label, key, seed)


def undersample(df: DataFrame, label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """As many rows of class 0 as of class 1."""
    return rebalance(df, 0.5, label, key, seed)


def oversample(df: DataFrame, label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Draw class 1 with replacement until it is as large as class 0.

    Every row of class 0 makes one draw: its hash picks a rank of class 1.  Draws are
    counted before the join, and a rank drawn very often is cut into chunks, so no
    task has to copy one row more than about COPIES_PER_CHUNK times.
    """
    minority = hash_rank(df.filter(F.col(label) == 1), label, key, seed)
    majority = df.filter(F.col(label) == 0)
    n_minority, n_majority = class_count(df, 1, label), class_count(df, 0, label)
    chunks = F.ceil(n_majority / F.greatest(n_minority, F.lit(1)) / COPIES_PER_CHUNK)
    draws = (
        majority.filter(n_minority > 0)
        .select(
            (F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), n_minority) + 1).alias("draw_rank"),
            F.pmod(F.xxhash64(F.col(key), F.lit(seed + 2)), chunks).alias("_chunk"),
        )
        .groupBy("draw_rank", "_chunk")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    chunked = minority.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1)))
    drawn = chunked.join(draws, ["draw_rank", "_chunk"]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))
    )
    return majority.unionByName(drawn.select(*df.columns))


def stratified_split(df: DataFrame, test_share: float = 0.2, label: str = LABEL, key: str = KEY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with round(share * n) test rows of every class."""
    draw = draw_per_class(df, F.round(F.col("_class_rows") * F.lit(float(test_share))), label, key, seed)
    return draw.apply(df, negate=True), draw.apply(df)


def _quotas(quotas: dict[int, int], used: dict[int, Column] | None = None) -> Column:
    left = F.lit(0)
    for value, n in quotas.items():
        left = F.when(F.col("_class") == value, F.lit(n) - used[value] if used else F.lit(n)).otherwise(left)
    return left


def balanced_sample(df: DataFrame, quotas: dict[int, int], label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """A fixed number of rows per class; fewer where a class is too small."""
    return take_per_class(df, _quotas(quotas), label, key, seed)


def hybrid_sample(recent: DataFrame, reference: DataFrame, quotas: dict[int, int], label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Fill each class from recent rows; reference rows cover only the shortfall."""
    shared = [c for c in recent.columns if c in reference.columns]
    slots = class_slots(recent, label, key, seed)
    fresh = draw_per_class(recent, _quotas(quotas), label, key, seed, slots).apply(recent)
    missing = _quotas(quotas, {value: rows_of_class(slots, value) for value in quotas})
    return fresh.select(*shared).unionByName(take_per_class(reference, missing, label, key, seed).select(*shared))


def head_tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first and the last n rows of a stated order, tagged `reference` and `current`."""
    first = df.orderBy(*[F.col(c).asc() for c in order]).limit(n)
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return first.withColumn("part", F.lit("reference")).unionByName(last.withColumn("part", F.lit("current")))


def stratified_folds(df: DataFrame, k: int = 5, label: str = LABEL, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Add `fold` in 0..k-1; every class is dealt out evenly."""
    ranked = hash_rank(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("draw_rank") - 1) % k).cast("int")).drop("draw_rank", "class_rows")
