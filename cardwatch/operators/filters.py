"""Row filters, validation and lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

TS = "trans_date_trans_time"


def outlier_filter(df: DataFrame, k: float = 3.0, column: str = "amt") -> DataFrame:
    """Rows above mean - k standard deviations; only the low side is cut."""
    bound = df.agg((F.avg(column) - F.lit(float(k)) * F.stddev_samp(column)).alias("bound")).scalar()
    return df.filter(F.col(column).cast("double") > bound)


def between_time(df: DataFrame, start: object, end: object, ts: str = TS) -> DataFrame:
    """start <= ts < end; literal bounds reach the scan as pushed filters."""
    return df.filter((F.col(ts) >= _instant(start)) & (F.col(ts) < _instant(end)))


def _instant(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def first_days(df: DataFrame, days: int = 30, inclusive: bool = False, ts: str = TS) -> DataFrame:
    """The first `days` days of the data, with or without the closing instant."""
    end = df.agg((F.min(ts) + F.expr(f"INTERVAL {int(days)} DAYS")).alias("end")).scalar()
    return df.filter(F.col(ts) <= end if inclusive else F.col(ts) < end)


def last_window(df: DataFrame, hours: int = 24, ts: str = TS, now: Column | None = None) -> DataFrame:
    """Rows no older than `hours` before the newest row (or before `now` when there is none)."""
    newest = F.max(ts) if now is None else F.coalesce(F.max(ts), now)
    start = df.agg((newest - F.expr(f"INTERVAL {int(hours)} HOURS")).alias("start")).scalar()
    return df.filter(F.col(ts) >= start)


def members(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    """IN-list filter; an empty list keeps everything, as an unset page filter does."""
    values = list(values)
    return df.filter(F.col(column).isin(values)) if values else df


def restrict(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Semi join.  The optimiser broadcasts `keys` when its measured size allows."""
    return df.join(keys.select(column), column, "left_semi")


def resolve_scope(df: DataFrame, merchant: str | None = None, pareto: DataFrame | None = None, column: str = "merchant_name") -> DataFrame:
    """A named merchant wins over the Pareto set, which wins over everything.

    An empty Pareto set restricts nothing.
    """
    if merchant is not None:
        return df.filter(F.col(column) == merchant)
    if pareto is None:
        return df
    none_kept = pareto.agg((F.count(F.lit(1)) == 0).alias("none_kept")).scalar()
    inside = df.join(pareto.select(column), column, "left_semi")
    return inside.unionByName(df.filter(none_kept))


def lookup(df: DataFrame, value: object, key: str = "trans_num") -> DataFrame:
    return df.filter(F.col(key) == value)


def validate(df: DataFrame) -> DataFrame:
    """Tag five-field payment requests: every field present, amount > 0, country of 2-3 letters."""
    fields = ("transaction_id", "user_id", "amount", "ip_address", "country")
    reason = F.concat_ws(
        ",",
        *[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in fields],
        F.when(~(F.col("amount") > 0), F.lit("amount not positive")),
        F.when(~F.length("country").between(2, 3), F.lit("country length")),
    )
    return df.withColumn("reject_reason", reason).withColumn("is_valid", F.col("reject_reason") == "")


def simple_score(df: DataFrame, amount: str = "amount") -> DataFrame:
    """The demonstration scorer: one amount threshold."""
    score = F.when(F.col(amount) > 5000, F.lit(0.95)).otherwise(F.lit(0.05))
    return df.withColumn("fraud_score", score).withColumn("is_fraud_predicted", F.col("fraud_score") > 0.8)


def read_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in a stated order: a top-n per task, merged."""
    return df.orderBy(*order).limit(n)
