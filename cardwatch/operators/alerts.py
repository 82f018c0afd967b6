"""Alert payloads, the rolling feed and the merge of its two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch import functions as fn
from cardwatch.operators.filters import last_window
from cardwatch.operators.history import first_by_key

# Event name and how long an alert is kept.
EVENT = "transaction.suspecte"
RETENTION_HOURS = 24
ATTRIBUTION = "map<string,double>"


def alert_payloads(scored: DataFrame) -> DataFrame:
    """One outbox row per predicted fraud: the message text and what it is keyed by.

    Rows that only the rules suspect send nothing.  The card leaves as a hash.
    """
    data = F.struct(
        F.col("trans_num").alias("transaction_id"),
        fn.card_hash(F.col("cc_num")).alias("cc_num_sha256"),
        F.col("amt").cast("double").alias("amount"),
        "category",
        "merchant",
        "prediction",
        F.col("prediction_proba").cast("double").alias("prediction_proba"),
        F.from_json("shap_values", ATTRIBUTION).alias("explications_shap"),
    )
    stamp = fn.iso_utc(F.col("trans_date_trans_time"))
    return scored.filter(F.col("prediction") == 1).select(
        "trans_num",
        F.col("trans_date_trans_time").alias("alert_ts"),
        F.to_json(F.struct(F.lit(EVENT).alias("event"), stamp.alias("timestamp"), data.alias("data"))).alias("payload"),
    )


PAYLOAD = (
    "event string, timestamp string, data struct<transaction_id:string, cc_num_sha256:string, amount:double, "
    "category:string, merchant:string, prediction:int, prediction_proba:double, explications_shap:map<string,double>>"
)


def read_payloads(outbox: DataFrame) -> DataFrame:
    """Outbox messages as feed rows."""
    message = F.from_json("payload", PAYLOAD)
    return outbox.select("alert_ts", message.alias("m")).select(
        "alert_ts",
        F.col("m.timestamp").alias("happened_at"),
        F.col("m.event").alias("event"),
        F.col("m.data.transaction_id").alias("transaction_id"),
        F.col("m.data.merchant").alias("merchant"),
        F.col("m.data.amount").alias("amount"),
        F.col("m.data.category").alias("category"),
        fn.class_label(F.col("m.data.prediction")).alias("verdict"),
        fn.percent_text(F.col("m.data.prediction_proba")).alias("probability"),
    )


def alert_history(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Feed rows rebuilt from the fact: predicted frauds of its last 24 hours."""
    recent = last_window(scored, RETENTION_HOURS, now=now).filter(F.col("prediction") == 1)
    return recent.select(
        F.col("trans_date_trans_time").alias("alert_ts"),
        fn.iso_utc(F.col("trans_date_trans_time")).alias("happened_at"),
        F.lit(EVENT).alias("event"),
        F.col("trans_num").alias("transaction_id"),
        "merchant",
        F.col("amt").cast("double").alias("amount"),
        "category",
        fn.class_label(F.col("prediction")).alias("verdict"),
        fn.percent_text(F.col("prediction_proba")).alias("probability"),
    )


def alert_feed(alerts: DataFrame, now: Column | None = None, ts: str = "alert_ts") -> DataFrame:
    """Alerts of the last 24 hours before `now` (default: the newest alert), newest first."""
    newest = now if now is not None else alerts.agg(F.max(ts).alias("now")).scalar()
    kept = alerts.filter(F.col(ts) > newest - F.expr(f"INTERVAL {RETENTION_HOURS} HOURS"))
    return kept.orderBy(F.col(ts).desc(), "trans_num")


def merge_alerts(cache: DataFrame, history: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Union by id; the cache wins over the history, and within a source the newest row."""
    both = cache.withColumn("_source", F.lit(0)).unionByName(history.withColumn("_source", F.lit(1)))
    return first_by_key(both, key, F.col("_source"), F.col("alert_ts").desc()).drop("_source")


def alert_counts(feed: DataFrame, merchant: str | None = None) -> DataFrame:
    """Alerts shown for a merchant (or all) and alerts in total."""
    shown = F.count(F.lit(1)) if merchant is None else F.count(F.when(F.col("merchant") == merchant, 1))
    return feed.agg(shown.alias("shown_alerts"), F.count(F.lit(1)).alias("total_alerts"))
