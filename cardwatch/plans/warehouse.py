"""Staging view and the six gold marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch import functions as fn
from cardwatch.session import durable

COUNT = "bigint"
# Latency limit of the service agreement in milliseconds.
SLA_MILLISECONDS = 20.0


def stg_transactions(fact: DataFrame, as_of_year: int = 2020) -> DataFrame:
    """The fact under its reporting names, with age and purchase distance."""
    return fact.select(
        F.col("trans_num").alias("transaction_id"),
        F.col("trans_date_trans_time").alias("transaction_timestamp"),
        F.col("cc_num").alias("credit_card_number"),
        F.col("merchant").alias("merchant_name"),
        F.col("category").alias("transaction_category"),
        F.col("amt").alias("transaction_amount"),
        F.col("gender").alias("customer_gender"),
        fn.age(F.col("dob"), as_of_year=as_of_year).alias("customer_age"),
        F.col("city_pop").alias("city_population"),
        fn.staging_distance(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")).alias("distance_achat"),
        F.col("prediction").alias("is_predicted_fraud"),
        F.col("prediction_proba").alias("prediction_probability"),
        "model_version",
        "fast_pass_suspicion",
        "fast_pass_score",
        "prediction_latency_ms",
        "shap_values",
        "logged_at",
    )


def _rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _amount_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("transaction_amount")).otherwise(F.lit(0).cast("decimal(10,2)")))


def _predicted(flag: int) -> Column:
    return F.col("is_predicted_fraud") == flag


def _suspected(flag: int) -> Column:
    return F.col("fast_pass_suspicion") == flag


def mart_merchant_daily_metrics(staged: DataFrame) -> DataFrame:
    """Volume, clean and blocked share per merchant and day; an unscored row is in neither."""
    n, frauds = F.count("transaction_id"), _rows_where(_predicted(1))
    return staged.groupBy(
        fn.txn_day(F.col("transaction_timestamp")).alias("transaction_date"), "merchant_name"
    ).agg(
        n.alias("total_transactions"),
        F.sum("transaction_amount").alias("total_volume"),
        _amount_where(_predicted(0)).alias("clean_volume"),
        _rows_where(_predicted(0)).alias("clean_transactions_count"),
        _amount_where(_predicted(1)).alias("blocked_fraud_volume"),
        frauds.alias("fraud_transactions_count"),
        fn.percent(frauds, n).alias("fraud_rate_percentage"),
    )


def mart_merchant_hourly_fraud(staged: DataFrame) -> DataFrame:
    return staged.groupBy("merchant_name", F.hour("transaction_timestamp").alias("transaction_hour")).agg(
        F.count("transaction_id").alias("total_transactions"),
        _rows_where(_predicted(1)).alias("fraud_transactions_count"),
        _amount_where(_predicted(1)).alias("fraud_volume_loss"),
        _rows_where(_suspected(1)).alias("fast_pass_suspicion_count"),
    )


def mart_fast_pass_performance(staged: DataFrame) -> DataFrame:
    """What the rules catch, what only the model catches, and both together, per day."""
    rules, model_only, either = _suspected(1), _suspected(0) & _predicted(1), _predicted(1) | _suspected(1)
    return staged.groupBy(fn.txn_day(F.col("transaction_timestamp")).alias("transaction_date")).agg(
        F.count("transaction_id").alias("total_transactions"),
        _rows_where(rules).alias("fast_pass_detections"),
        _amount_where(rules).alias("fast_pass_blocked_amount"),
        _rows_where(model_only).alias("model_only_detections"),
        _amount_where(model_only).alias("model_only_blocked_amount"),
        _rows_where(either).alias("total_detections"),
        _amount_where(either).alias("total_blocked_amount"),
    )


def mart_merchant_shap_importance(staged: DataFrame) -> DataFrame:
    """Mean absolute attribution per merchant over its predicted frauds."""
    document = F.col("shap_values")
    frauds = staged.filter(_predicted(1)).select(
        "merchant_name",
        fn.json_number(document, "amt").alias("amt"),
        fn.json_number(document, "distance_achat").alias("distance"),
        fn.json_number(document, "age").alias("age"),
        fn.json_number(document, "city_pop").alias("city_pop"),
        (fn.json_number(document, "hour_sin") + fn.json_number(document, "hour_cos")).alias("time"),
    )
    return frauds.groupBy("merchant_name").agg(
        F.count(F.lit(1)).alias("total_fraud_cases"),
        *[
            fn.ratio_half_up(F.sum(F.abs(F.col(c))), F.count(c), 3).alias(f"avg_{c}_impact")
            for c in ("amt", "distance", "age", "city_pop", "time")
        ],
    )


def mart_operational_sla(staged: DataFrame) -> DataFrame:
    n, latency = F.count("transaction_id"), F.col("prediction_latency_ms")
    return staged.groupBy(fn.txn_day(F.col("transaction_timestamp")).alias("check_date")).agg(
        n.alias("total_api_calls"),
        fn.ratio_half_up(F.sum(latency), F.count(latency), 2).alias("avg_latency_ms"),
        F.round(F.max(latency), 2).alias("max_latency_ms"),
        fn.percent(_rows_where(latency < SLA_MILLISECONDS), n).alias("sla_compliance_percentage"),
    )


def mart_merchant_blocked_transactions(staged: DataFrame) -> DataFrame:
    """Every predicted or suspected row; the card number leaves as a hash."""
    return staged.filter(_predicted(1) | _suspected(1)).select(
        "transaction_id",
        "transaction_timestamp",
        "merchant_name",
        fn.card_hash(F.col("credit_card_number")).alias("credit_card_sha256"),
        "transaction_amount",
        "transaction_category",
        "customer_age",
        "customer_gender",
        "distance_achat",
        "fast_pass_suspicion",
        "fast_pass_score",
        "is_predicted_fraud",
        "prediction_probability",
        "model_version",
    )


MARTS = {
    "mart_merchant_daily_metrics": mart_merchant_daily_metrics,
    "mart_merchant_hourly_fraud": mart_merchant_hourly_fraud,
    "mart_fast_pass_performance": mart_fast_pass_performance,
    "mart_merchant_shap_importance": mart_merchant_shap_importance,
    "mart_operational_sla": mart_operational_sla,
    "mart_merchant_blocked_transactions": mart_merchant_blocked_transactions,
}


def build_marts(fact: DataFrame, database: str = "gold", path: str | None = None) -> list[str]:
    """Register staging as a view and rebuild every mart.

    Marts become tables of `database`, or parquet folders under `path`.  The staging
    columns they share are written once, so the six marts scan that narrow copy.
    """
    spark = fact.sparkSession
    staged = stg_transactions(fact)
    staged.createOrReplaceTempView("stg_transactions")
    shared = durable(staged, "staging")
    if path is None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, mart in MARTS.items():
        rows = mart(shared)
        if path is None:
            rows.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(MARTS)
