"""Running totals, exact percentiles and rank sums over a globally ordered column.

`SUM() OVER (ORDER BY x)` with no partition key sends every row to one task.
Here rows are first counted per distinct value; the values are then laid out in ranges of
bounded size, each range is summed on its own, and the totals of the ranges before
it are carried in (`operators/ranges.py`).  The answer is the exact window result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.operators.ranges import RANGE_ROWS, in_ranges, with_running
from cardwatch.session import durable



def running_totals(
    hist: DataFrame,
    value: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact running sums in ascending order of `value`.

    `hist` holds one row per (group, value); `group` has few values (column names,
    classes).  Adds `cum_<s>` (up to and including the value), `total_<s>` and
    `next_value` (the next larger value of the group, NULL on the last).
    """
    group = list(group)
    hist = durable(hist, "histogram")
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    if hist.count() <= range_rows:
        # bounded: at most range_rows rows in all
        ordered = whole.orderBy(value)
        so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
        return hist.select(
            *hist.columns,
            *[F.sum(s).over(so_far).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
            F.lead(value).over(ordered).alias("next_value"),
        )
    placed = in_ranges(hist, [*group, value], hist.columns, range_rows, "ranges")
    running = with_running(placed, {f"cum_{s}": F.col(s) for s in sums}, group, following={"next_value": value})
    totals = hist.groupBy(*group).agg(*[F.sum(s).alias(f"total_{s}") for s in sums])
    if not group:
        return running.select(*hist.columns, *[f"cum_{s}" for s in sums], *[totals.select(f"total_{s}").scalar().alias(f"total_{s}") for s in sums], "next_value")
    # one row per column name or class
    totals = F.broadcast(totals.withColumnsRenamed({g: f"_of_{g}" for g in group}))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return running.join(totals, same).select(*hist.columns, *[f"cum_{s}" for s in sums], *[f"total_{s}" for s in sums], "next_value")


def exact_percentiles(
    df: DataFrame,
    value: str,
    shares: dict[str, float],
    group: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Linearly interpolated percentiles, one row per group; NULL values are ignored.

    Equal to `percentile()`, which instead keeps every distinct value in one task.
    """
    group = list(group)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(hist, "v", ["n"], group, range_rows)

    def at(position: Column) -> Column:
        holds = (position >= F.col("cum_n") - F.col("n")) & (position < F.col("cum_n"))
        return F.max(F.when(holds, F.col("v")))

    steps, results = [], []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("total_n") - 1)
        steps += [
            at(F.floor(place)).alias(f"low_{name}"),
            at(F.ceil(place)).alias(f"high_{name}"),
            F.max(place - F.floor(place)).alias(f"part_{name}"),
        ]
        low, high = F.col(f"low_{name}"), F.col(f"high_{name}")
        results.append((low + (high - low) * F.col(f"part_{name}")).alias(name))
    return ranked.groupBy(*group).agg(*steps).select(*group, *results)
