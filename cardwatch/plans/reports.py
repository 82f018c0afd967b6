"""Queries behind the report pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch import functions as fn
from cardwatch.functions.numbers import MONEY
from cardwatch.operators.filters import TS
from cardwatch.operators.hotkeys import attach_per_key
from cardwatch.operators.ordered import running_totals

# The share of fraud volume the critical merchants must cover.
PARETO_PERCENT = 80.0


def global_stats(fact: DataFrame) -> DataFrame:
    """Rows, frauds and fraud rate; 0 when empty."""
    frauds = F.coalesce(F.sum("is_fraud"), F.lit(0))
    rate = F.try_divide(frauds.cast("double") * 100.0, F.count(F.lit(1)).cast("double"))
    return fact.agg(
        F.count(F.lit(1)).alias("total_tx"),
        frauds.alias("total_fraud"),
        F.coalesce(rate, F.lit(0.0)).alias("fraud_rate"),
    )


def day_over_day(fact: DataFrame) -> DataFrame:
    """Last day against the day before; a day without rows counts 0.

    The newest day is a scalar subquery over one column; the two days are then one
    filtered scan.
    """
    last = fact.agg(F.to_date(F.max(TS)).alias("day")).scalar()
    day = F.to_date(TS)
    recent = fact.filter((F.col(TS) >= F.date_sub(last, 1).cast("timestamp_ntz"))).withColumn("_today", day == last)

    def rows(today: bool) -> Column:
        return F.count(F.when(F.col("_today") == today, 1))

    def frauds(today: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_today") == today, F.col("is_fraud"))), F.lit(0))

    def rate(today: bool) -> Column:
        share = F.try_divide(frauds(today).cast("double") * 100.0, rows(today).cast("double"))
        return F.coalesce(share, F.lit(0.0))

    return recent.agg(
        rows(True).alias("today_tx"),
        frauds(True).alias("today_fraud"),
        rate(True).alias("today_rate"),
        rows(False).alias("yesterday_tx"),
        frauds(False).alias("yesterday_fraud"),
        rate(False).alias("yesterday_rate"),
        (rows(True) - rows(False)).alias("tx_delta"),
        (frauds(True) - frauds(False)).alias("fraud_delta"),
        (rate(True) - rate(False)).alias("rate_delta"),
    ).select(last.alias("last_day"), "*")


def merchant_summary(daily: DataFrame) -> DataFrame:
    """Merchant totals with the unweighted mean of the daily fraud rate."""
    return (
        daily.groupBy("merchant_name")
        .agg(
            *[F.sum(c).alias(c) for c in ("total_transactions", "total_volume", "clean_volume", "blocked_fraud_volume")],
            F.avg(F.col("fraud_rate_percentage").cast("double")).alias("mean_daily_fraud_rate"),
        )
        .orderBy(F.col("total_volume").desc(), "merchant_name")
    )


def hourly_summary(hourly: DataFrame) -> DataFrame:
    sums = ("total_transactions", "fraud_transactions_count", "fraud_volume_loss")
    return hourly.groupBy("transaction_hour").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("transaction_hour")


def attribution_summary(importance: DataFrame) -> DataFrame:
    """Mean of the merchant means as (variable, impact) rows, weakest first."""
    columns = [f"avg_{c}_impact" for c in ("amt", "distance", "age", "city_pop", "time")]
    means = importance.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return means.unpivot([], columns, "variable", "impact").orderBy("impact", "variable")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def resume_point(fact: DataFrame) -> DataFrame:
    return fact.agg(F.max(TS).alias("resume_at"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def pareto(daily: DataFrame, percent: float = PARETO_PERCENT) -> DataFrame:
    """The merchants that together carry `percent` of the blocked fraud volume.

    Volumes are accumulated from the largest down; merchants of equal volume share
    one running total, the merchant that crosses the limit is kept.  The running sum
    is taken over distinct volumes in ranges, so no task sees every merchant.
    """
    merchants = daily.groupBy("merchant_name").agg(F.sum("blocked_fraud_volume").cast(MONEY).alias("fraud_volume"))
    volumes = merchants.groupBy("fraud_volume").agg(
        F.count(F.lit(1)).alias("tied"),
        F.min("merchant_name").alias("first_name"),
        F.sum("fraud_volume").alias("volume"),
    )
    ranked = running_totals(volumes.filter("fraud_volume is not null"), "fraud_volume", ["volume"])
    everything, here = F.col("total_volume"), F.col("volume")
    running = everything - F.col("cum_volume") + here
    steps = ranked.select("fraud_volume", "tied", "first_name", everything.alias("everything"), running.alias("running"), (running - here).alias("before"))
    # a tie group's first merchant follows the group above, the others follow their own
    rows = attach_per_key(merchants.filter("fraud_volume > 0"), steps, "fraud_volume", "tied")
    previous = F.when(F.col("merchant_name") == F.col("first_name"), F.col("before")).otherwise(F.col("running"))

    def share(volume: Column) -> Column:
        return F.coalesce(fn.percent(volume, F.col("everything")), F.lit(0))

    return (
        rows.filter(share(previous) < percent)
        .select("merchant_name", "fraud_volume", share(F.col("running")).alias("cum_percentage"))
        .orderBy(F.col("fraud_volume").desc(), "merchant_name")
    )


def pareto_summary(critical: DataFrame, daily: DataFrame) -> DataFrame:
    """How many merchants are critical, of how many, and what they cover."""
    merchants = daily.agg(F.count_distinct("merchant_name").alias("n")).scalar()
    return critical.agg(F.count(F.lit(1)).alias("critical"), F.max("cum_percentage").alias("max_cum_percentage")).select(
        "critical",
        merchants.alias("merchants"),
        F.coalesce(F.try_divide(F.col("critical") * 100.0, merchants.cast("double")), F.lit(0.0)).alias("critical_share"),
        "max_cum_percentage",
    )


def newest_first(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), key)


def latest_suspicious(fact: DataFrame, merchant: str | Column, n: int = 50) -> DataFrame:
    """The newest predicted frauds of one merchant: a top-n per task, merged."""
    mine = fact.filter((F.col("merchant") == merchant) & (F.col("prediction") == 1))
    return mine.orderBy(F.col(TS).desc(), "trans_num").limit(n)


def latest_blocked(blocked: DataFrame, n: int = 100) -> DataFrame:
    return newest_first(blocked, "transaction_timestamp", "transaction_id").limit(n)


def most_fraudulent(critical: DataFrame) -> DataFrame:
    return critical.orderBy(F.col("fraud_volume").desc(), "merchant_name").limit(1)


def transaction_card(fact: DataFrame, trans_num: str) -> DataFrame:
    """The detail panel of one payment."""
    return fact.filter(F.col("trans_num") == trans_num).select(
        "trans_num",
        fn.card_hash(F.col("cc_num"), 16).alias("card"),
        "category",
        "amt",
        fn.age(F.col("dob"), F.col(TS), "transaction_year").alias("age"),
        "gender",
        F.round(fn.haversine_km(*[F.col(c) for c in ("lat", "long", "merch_lat", "merch_long")]), 2).alias("distance_km"),
        "city_pop",
        fn.percent_text(F.col("prediction_proba")).alias("probability"),
    )
