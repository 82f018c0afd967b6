"""Edge rows of rules, joins, sinks, reports and drift."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import tails
from cardwatch.operators import alerts, drift, features as ft, filters, history, metrics, rules
from cardwatch.plans import explain, reports, training, warehouse
from cardwatch.schema import RAW_TRANSACTION, RULES
from cardwatch.sources import files, sinks

RECORD = {
    "trans_date_trans_time": dt.datetime(2020, 7, 22, 23, 5), "cc_num": 123456789, "merchant": "fraud_gas_station",
    "category": "travel", "amt": 500.0, "first": "A", "last": "B", "gender": "F", "street": "1 Main Street", "city": "Lyon",
    "state": "Rhone", "zip": 69000, "lat": 45.764043, "long": 4.835659, "city_pop": 513000, "job": "engineer",
    "dob": dt.date(1985, 4, 12), "trans_num": "x1", "unix_time": 1595426700, "merch_lat": 45.768, "merch_long": 4.84, "is_fraud": 0,
}
RULE_ROW = ({"amt_max": 300.0, "distance_achat_max": 50.0, "age_max": 38.0, "city_pop_max": 3600.0}, ["travel", "food_dining"], [3, 22, 23], [5, 6], [6])


def transactions(spark, *changes):
    import decimal

    def row(change):
        values = {**RECORD, **change}
        return tuple(
            decimal.Decimal(str(values[f.name])) if f.dataType.typeName() == "decimal" and values[f.name] is not None else values[f.name]
            for f in RAW_TRANSACTION.fields
        )

    return spark.createDataFrame([row(c) for c in changes or ({},)], RAW_TRANSACTION)


def scored(spark, document, *changes):
    return rules.fast_pass(ft.engineered(transactions(spark, *changes)), document).collect()


def test_known_transaction_scores_five(spark):
    found = scored(spark, spark.createDataFrame([RULE_ROW], RULES))[0]
    assert (found["fast_pass_score"], found["fast_pass_suspicion"]) == (5, 1)


def test_rules_are_strict_and_default(spark):
    document = spark.createDataFrame([RULE_ROW], RULES)
    at_limit, weekend = scored(spark, document, {"amt": 300.0}, {"trans_date_trans_time": dt.datetime(2020, 7, 25, 10, 0)})
    assert at_limit["fast_pass_score"] == 3
    assert weekend["fast_pass_score"] == 5  # Saturday instead of the late hour
    no_thresholds = spark.createDataFrame([({}, None, None, None, None)], RULES)
    assert scored(spark, no_thresholds)[0]["fast_pass_score"] == 3  # default limits: amount and city
    assert scored(spark, document.limit(0))[0]["fast_pass_score"] == 0


def test_first_record_of_a_key_wins(spark):
    batch = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "new"), ("c", 1, "old")], "trans_num string, n int, v string")
    target = spark.createDataFrame([("c",)], "trans_num string")
    found = {r["trans_num"]: r["v"] for r in sinks.insert_if_absent(batch, target, arrival=[F.col("n")]).collect()}
    assert found == {"a": "early", "b": "new"}


def test_copies_of_a_key_are_cut_before_the_shuffle(fact):
    plan = history.first_by_key(fact, "trans_num", F.col("event_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_validation(spark):
    data = [("t", "u", 1.0, "ip", "FRA"), ("t", "u", 0.0, "ip", "FRA"), ("t", None, 1.0, "ip", "FR"), ("t", "u", 1.0, "ip", "F"), ("t", "u", None, "ip", "FRANCE")]
    df = spark.createDataFrame(data, "transaction_id string, user_id string, amount double, ip_address string, country string")
    assert [r["is_valid"] for r in filters.validate(df).collect()] == [True, False, False, False, False]


def test_on_demand_defaults(spark):
    empty = spark.createDataFrame(
        [(None,) * 10], "category string, amt float, gender string, city_pop bigint, lat float, long float, merch_lat float, merch_long float, dob string, trans_date_trans_time string"
    )
    row = ft.on_demand_features(empty).first()
    assert (row["category"], row["gender"], row["amt"], row["city_pop"], row["age"]) == ("unknown", "unknown", 0.0, 0, 40)
    assert (row["hour_cos"], row["distance_achat"]) == (1.0, 0.0)


def test_old_features_expire(spark):
    features = spark.createDataFrame([(1, "F", 10, "a", "2023-01-01"), (2, "M", 20, "b", "2024-01-01")], "cc_num bigint, gender string, city_pop int, trans_num string, d string")
    features = features.withColumn("logged_at", F.col("d").cast("timestamp_ntz"))
    requests = spark.createDataFrame([(1,), (2,), (3,)], "cc_num bigint")
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    found = {r["cc_num"]: r["gender"] for r in history.enrich(requests, features, ("gender", "city_pop"), as_of=now).collect()}
    assert found == {1: None, 2: "M", 3: None}


def test_pareto_ties_share_a_total(spark):
    daily = spark.createDataFrame(
        [("a", 40.0), ("b", 20.0), ("c", 20.0), ("d", 15.0), ("e", 5.0), ("f", 0.0)], "merchant_name string, v double"
    ).select("merchant_name", F.col("v").cast("decimal(12,2)").alias("blocked_fraud_volume"))
    found = [(r["merchant_name"], float(r["cum_percentage"])) for r in reports.pareto(daily).collect()]
    # c follows the shared 80 % of its tie group, so only a and b are below the limit
    assert found == [("a", 40.0), ("b", 80.0)]
    nothing = daily.withColumn("blocked_fraud_volume", F.lit(0).cast("decimal(12,2)"))
    assert reports.pareto(nothing).count() == 0


def test_scope(spark):
    daily = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "merchant_name string, n int")
    assert filters.resolve_scope(daily).count() == 3
    assert filters.resolve_scope(daily, "a", daily.limit(0)).count() == 1
    assert filters.resolve_scope(daily, None, daily.filter("n = 2")).count() == 1
    assert filters.resolve_scope(daily, None, daily.limit(0)).count() == 3


def test_unscored_rows_are_in_neither_class(fact):
    unscored = warehouse.stg_transactions(fact.withColumn("prediction", F.lit(None).cast("int")))
    totals = warehouse.mart_merchant_daily_metrics(unscored).agg(
        F.sum("total_transactions").alias("n"), F.sum("clean_transactions_count").alias("clean"), F.sum("fraud_transactions_count").alias("fraud")
    ).first()
    assert (totals["n"], totals["clean"], totals["fraud"]) == (fact.count(), 0, 0)


def test_reports_on_no_rows(fact):
    none = fact.limit(0)
    assert tuple(reports.global_stats(none).first()) == (0, 0, 0.0)
    assert reports.day_over_day(none).first()["today_tx"] == 0
    assert filters.last_window(none, now=F.lit("2024-01-01").cast("timestamp_ntz")).count() == 0
    figures = metrics.classification_metrics(metrics.confusion_matrix(none)).first()
    assert figures["f1_class_1"] == 0.0 and figures["accuracy"] == 0.0


def test_metrics_match_published_counts(spark):
    matrix = spark.createDataFrame([(1469, 27, 0, 4)], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = metrics.classification_metrics(matrix).first()
    assert round(row["f1_class_1"], 5) == 0.22857 and row["rec_class_1"] == 1.0


def test_js_and_tail_probabilities(spark):
    tagged = spark.createDataFrame([("reference", "a")] * 3 + [("reference", "b")] + [("current", "b")] * 2, "part string, c string")
    import math

    p, q = (0.75, 0.25), (0.0, 1.0)
    middle = [(a + b) / 2 for a, b in zip(p, q)]
    expected = math.sqrt(sum(x * math.log(x / m) for side in (p, q) for x, m in zip(side, middle) if x > 0) / 2)
    assert abs(drift.js_distance(tagged, ["c"]).first()["metric_value"] - expected) < 1e-12
    # published quantiles of the chi-square and Kolmogorov distributions
    def value(tail, *numbers):
        return spark.range(1).select(tail(*[F.lit(x) for x in numbers]).alias("p")).first()["p"]

    assert abs(value(tails.chi_square_tail, 3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(value(tails.chi_square_tail, 7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(value(tails.chi_square_tail, 9.487729036781154, 4) - 0.05) < 1e-9
    assert value(tails.kolmogorov_tail, 0.0, 100.0, 100.0) == 1.0
    assert 0.04 < value(tails.kolmogorov_tail, 1.36 / math.sqrt(500), 1000.0, 1000.0) < 0.06


def test_half_of_the_columns_is_no_drift(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=h), float(h % 7), float(h % 5)) for h in range(24 * 30)]
    rows += [(base + dt.timedelta(days=30, hours=h % 24, minutes=h), float(h % 7) + 100, float(h % 5)) for h in range(35)]
    df = spark.createDataFrame(rows, "t timestamp, moved double, still double").withColumn("trans_date_trans_time", F.col("t").cast("timestamp_ntz"))
    verdict, details = drift.drift_report(df, "2024-02-01", ["moved", "still"], [])
    flags = {r["column_name"]: r["drift_detected"] for r in details.collect()}
    assert flags == {"moved": True, "still": False}
    assert verdict.first()["drift_detected"] is False
    few, _ = drift.drift_report(df, "2024-02-02", ["moved"], [])
    assert few.first()["testable"] is False
    empty, _ = drift.drift_report(df, "2024-03-15", ["moved"], [])
    with pytest.raises(Exception, match="no rows"):
        drift.needs_retrain(empty).collect()


def test_payload_and_merge(fact):
    payload = json.loads(alerts.alert_payloads(fact).first()["payload"])
    assert payload["event"] == "transaction.suspecte" and len(payload["data"]["cc_num_sha256"]) == 64
    assert set(payload["data"]["explications_shap"]) == set(explain.REPORTED)
    assert alerts.alert_payloads(fact).count() == fact.filter("prediction = 1").count()


def test_attributions_add_up_to_the_linear_score(fact):
    rows = ft.engineered(fact)
    model = training.train_lr(rows, iterations=20)
    weights = explain.linear_weights(model)
    total = explain.contribution_rows(rows, weights).groupBy("trans_num").agg(F.sum("contribution").alias("total"))
    from pyspark.ml.functions import vector_to_array

    inputs = rows.select("trans_num", *[training.model_input(c) for c in model.columns])
    raw = model.transform(inputs).select("trans_num", vector_to_array("rawPrediction")[1].alias("raw"))
    intercept = model.pipeline.stages[-1].intercept
    gap = total.join(raw, "trans_num").agg(F.max(F.abs(F.col("total") + intercept - F.col("raw"))).alias("gap")).first()["gap"]
    assert gap < 1e-6


def test_text_rows_keep_long_card_numbers(spark, tmp_path):
    path = str(tmp_path / "in")
    header = ",".join(RAW_TRANSACTION.names)
    line = "2020-07-22 23:05:00,4992346398065154184,m,travel,oops,A,B,F,s,c,st,69000,1.5,2.5,12,j,1985-04-12,x,1,1.5,2.5,0"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"{header}\n{line}\n")
    row = files.read_raw_strings(spark, path).first()
    assert row["cc_num"] == "4992346398065154184" and row["amt"] is None and row["lat"] == 1.5
    typed = files.typed(spark.read.schema(files.RAW_TEXT).csv(path, header=True)).first()
    assert typed["cc_num"] == 4992346398065154184 and typed["trans_date_trans_time"] == dt.datetime(2020, 7, 22, 23, 5)


def test_missing_rules_and_table_fallback(spark, tmp_path):
    assert files.read_rules(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(RAW_TRANSACTION.names) + "\n")
    assert files.read_with_fallback(spark, "no_table_here", str(tmp_path / "in")).count() == 0


def test_marts_as_tables(spark, fact):
    names = warehouse.build_marts(fact, "gold")
    assert sorted(t.name for t in spark.catalog.listTables("gold") if not t.isTemporary) == sorted(names)
    assert spark.table("stg_transactions").count() == fact.count()


def test_unreadable_or_empty_rules_are_no_rules(spark):
    from cardwatch.sources.files import parse_rules

    documents = spark.createDataFrame([("not json",), ("{}",), (None,)], "value string")
    assert parse_rules(documents, "value").count() == 0
    one = spark.createDataFrame([('{"thresholds": {"amt_max": 1.0}}',)], "value string")
    assert parse_rules(documents.union(one), "value").count() == 1


def test_velocity_keeps_rows_of_any_id(spark):
    data = [("a", 1, "2024-01-01 10:00:00", 5.0), ("a", 1, "2024-01-01 10:30:00", 7.0), (None, 1, "2024-01-01 10:45:00", 1.0), ("b", None, "2024-01-01 10:00:00", 2.0), ("c", 1, None, 2.0)]
    df = spark.createDataFrame(data, "trans_num string, cc_num bigint, t string, amt double")
    df = df.withColumn("trans_date_trans_time", F.col("t").cast("timestamp_ntz"))
    for limit in (100, 0):
        found = [(r["trans_num"], r["count_1h"], r["sum_24h"] and float(r["sum_24h"])) for r in history.velocity_features(df, frame_rows=limit).collect()]
        assert sorted(found, key=str) == sorted([("a", 1, 5.0), ("a", 2, 12.0), (None, 3, 13.0), ("b", None, None), ("c", None, None)], key=str)


def test_lookup_without_a_card(spark):
    features = spark.createDataFrame([(1, "F", "a"), (None, "M", "b")], "cc_num bigint, gender string, trans_num string")
    features = features.withColumn("logged_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    requests = spark.createDataFrame([(1, "x"), (None, "y"), (None, None)], "cc_num bigint, id string").withColumn("asked", F.lit("2024-02-01").cast("timestamp_ntz"))
    found = [(r["id"], r["gender"]) for r in history.enrich_as_of(requests, features, "id", "asked", ("gender",)).collect()]
    assert sorted(found, key=str) == sorted([("x", "F"), ("y", None), (None, None)], key=str)


def test_insert_without_a_key_is_an_error(spark):
    batch = spark.createDataFrame([("a",), (None,)], "trans_num string")
    with pytest.raises(Exception, match="has no trans_num"):
        sinks.insert_if_absent(batch, batch.limit(0)).collect()


def test_a_stored_model_scores_alike(fact, tmp_path):
    rows = ft.engineered(fact)
    model = training.train_lr(rows, iterations=5)
    model.save(rows.sparkSession, str(tmp_path / "model"))
    loaded = training.Model.load(rows.sparkSession, str(tmp_path / "model"))
    assert loaded.columns == model.columns
    both = [training.score(rows, m).select("trans_num", "prediction", "prediction_proba") for m in (model, loaded)]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].count() == rows.count()


def test_missing_values_are_attributed_as_the_model_saw_them(fact):
    rows = ft.engineered(fact).withColumn("amt", F.when(F.col("event_id") % 7 != 0, F.col("amt")))
    weights = {"amt": explain.Weight(0.8, 70.0, 50.0)}
    missing = explain.contribution_rows(rows.filter("amt IS NULL"), weights).select("value", "contribution").distinct().collect()
    assert [(r["value"], round(r["contribution"], 9)) for r in missing] == [(0.0, -1.12)]


def test_hashed_text_is_not_attributed(fact):
    model = training.train_lr(ft.engineered(fact), ["merchant", "amt", "category"], iterations=2)
    with pytest.raises(ValueError, match="merchant"):
        explain.linear_weights(model)
