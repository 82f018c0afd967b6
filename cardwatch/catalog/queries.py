"""Named queries: (session, data folder) -> DataFrame, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cardwatch import functions as fn
from cardwatch.operators import alerts, drift, features as ft, filters, history, metrics, rules, sampling
from cardwatch.plans import champions, explain, reports, retrain, training, warehouse
from cardwatch.schema import RAW_TRANSACTION, SCORED_TRANSACTION, align_schema, union_evolving
from cardwatch.session import durable, scratch_path
from cardwatch.sources import files, fixture, rejects, sinks
from cardwatch.streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OPERATORS: dict[str, str] = {}


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain types on the outside: bigint, double (rounded), string, boolean."""

    def plain(f: T.StructField) -> Column:
        column, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return column.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, operators: str) -> Callable[[Query], Query]:
    """Register a query and the inventory entries it covers."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(build(spark, sf_dir))

        QUERIES[name], OPERATORS[name] = run, operators
        return build

    return register


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.transactions(spark, sf_dir)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.stg_transactions(fact(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.mart_merchant_daily_metrics(staged(spark, sf_dir))


# ---- scans, sources, sinks --------------------------------------------------------


@query("scored_fact", "S4 F1 F2 F18")
def _(spark, sf_dir):
    return fact(spark, sf_dir).select(*[c for c in SCORED_TRANSACTION.names if c != "prediction_latency_ms"])


@query("csv_typed_scan", "S1 K4")
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_csv(fixture.raw_transactions(spark, sf_dir).select(*RAW_TRANSACTION.names), path)
    return files.read_transactions(spark, path)


@query("csv_text_coercion", "S2 F18")
def _(spark, sf_dir):
    path = scratch_path(spark, "text")
    text = fixture.raw_transactions(spark, sf_dir).select(*RAW_TRANSACTION.names)
    bad = F.col("category") == "error"
    broken = text.withColumns(
        {
            "amt": F.when(bad, F.lit("n/a")).otherwise(F.col("amt").cast("string")),
            "city_pop": F.when(bad, F.lit("12x")).otherwise(F.col("city_pop").cast("string")),
            "cc_num": F.concat(F.col("cc_num").cast("string"), F.lit("987")),
        }
    )
    sinks.write_csv(broken, path)
    return files.read_raw_strings(spark, path).select(
        "trans_num", "cc_num", "amt", "lat", "long", "city_pop", "unix_time", "merch_lat", "merch_long", "is_fraud"
    )


@query("rejected_rows", "S2 P19")
def _(spark, sf_dir):
    """Broken text rows are read, and kept by reason next to the good ones."""
    path, kind = scratch_path(spark, "broken"), F.pmod(F.substring("trans_num", 2, 12).cast("long"), F.lit(40))
    text = fixture.raw_transactions(spark, sf_dir).select(*RAW_TRANSACTION.names)
    broken = text.withColumns(
        {
            "amt": F.when(kind == 1, F.lit("n/a")).otherwise(F.col("amt").cast("string")),
            "trans_date_trans_time": F.when(kind != 2, F.date_format("trans_date_trans_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
            "zip": F.when(kind == 3, F.lit("abc")).otherwise(F.col("zip").cast("string")),
            "trans_num": F.when(kind != 4, F.col("trans_num")),
            "cc_num": F.when(kind != 4, F.col("cc_num")),
        }
    )
    sinks.write_csv(broken, path)
    checked = scratch_path(spark, "checked")
    rejects.write_checked(rejects.read_csv_with_lines(spark, path), checked)
    good = rejects.accepted(spark, checked).select(F.lit("").alias("reject_reason"), F.col("amt").alias("amt"))
    bad = rejects.rejected(spark, checked).select("reject_reason", F.lit(None).cast("decimal(10,2)").alias("amt"))
    return good.unionByName(bad).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amt").alias("volume"))


@query("first_rows", "S3")
def _(spark, sf_dir):
    return filters.read_head(fact(spark, sf_dir), 25, "trans_date_trans_time", "trans_num").select("trans_num", "amt")


@query("backfill_projection", "S5")
def _(spark, sf_dir):
    return fact(spark, sf_dir).select(
        "trans_num", "trans_date_trans_time", "category", "amt", "gender", "lat", "long", "merch_lat", "merch_long", "dob", "city_pop"
    )


@query("feature_source", "S7")
def _(spark, sf_dir):
    return files.feature_source(fact(spark, sf_dir))


@query("table_or_csv", "S6")
def _(spark, sf_dir):
    path = scratch_path(spark, "fallback")
    sinks.write_csv(fixture.raw_transactions(spark, sf_dir).select(*RAW_TRANSACTION.names), path)
    found = files.read_with_fallback(spark, "no_such_database_table", path)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amt").alias("volume"))


def day_table(spark: SparkSession, sf_dir: str) -> str:
    """The name of a new table of the scored fact by event day."""
    name = f"fact_{uuid.uuid4().hex}"
    files.write_day_table(fact(spark, sf_dir), name, scratch_path(spark, name))
    return name


@query("table_days", "S4")
def _(spark, sf_dir):
    rows = files.read_table(spark, day_table(spark, sf_dir), ["trans_num", "amt", "event_day"])
    return rows.filter(F.col("event_day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")))


@query("table_first", "S6")
def _(spark, sf_dir):
    found = files.read_with_fallback(spark, day_table(spark, sf_dir), scratch_path(spark, "no-csv"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amt").alias("volume"))


@query("metric_files", "S10 K5")
def _(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = fact(spark, sf_dir).filter("prediction is not null")
    counts = rows.groupBy("category").agg(
        F.count(F.when(F.expr("is_fraud = 1 AND prediction = 1"), 1)).alias("tp"),
        F.count(F.when(F.expr("is_fraud = 0 AND prediction = 1"), 1)).alias("fp"),
    )
    document = F.create_map("category", F.create_map(F.lit("tp"), F.col("tp"), F.lit("fp"), F.col("fp")))
    counts.select(F.to_json(document).alias("value")).write.text(path)
    return files.flatten_metrics(spark.read.text(path), F.col("value"))


@query("insert_if_absent", "K1 J1 W6")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    stored = rows.filter(F.col("trans_date_trans_time") < F.lit("2024-01-15").cast("timestamp_ntz"))
    batch = rows.filter(F.col("trans_date_trans_time") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    late_copy = batch.withColumns({"amt": F.col("amt") + 1, "arrival": F.lit(2)})
    arriving = late_copy.unionByName(batch.withColumn("arrival", F.lit(1)))
    return sinks.insert_if_absent(arriving, stored, arrival=[F.col("arrival")]).select("trans_num", "amt", "arrival")


@query("stored_batches", "K1 T3 U1")
def _(spark, sf_dir):
    rows = fixture.transactions(spark, sf_dir)
    path = scratch_path(spark, "fact")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    overlap = F.lit("2024-01-12").cast("timestamp_ntz")
    ts = F.col("trans_date_trans_time")
    first, second = rows.filter(ts < middle), rows.filter(ts >= overlap)
    for number, batch in enumerate([first, second, second]):
        sinks.append_if_absent(batch, path, min(number, 1), logged_at=ts)
    return sinks.read_scored(spark, path).select("trans_num", "amt", "prediction", "batch_id", "logged_at")


@query("keyed_backfill", "K3 J3")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    fresh = rows.filter("fast_pass_suspicion = 1").select(
        "trans_num",
        F.lit(1).alias("prediction"),
        F.lit(0.75).alias("prediction_proba"),
        fn.version_label(2).alias("model_version"),
    )
    return sinks.backfill(rows, fresh).select("trans_num", "prediction", "prediction_proba", "model_version", "amt")


@query("file_ledger", "K2 F14")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    return sinks.file_ledger(queue.slice_bins(rows, *queue.whole_days(rows), 30)).select("file_name", "n_rows")


@query("schema_evolution", "K7")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    added = ["fast_pass_suspicion", "fast_pass_score", "prediction_latency_ms", "shap_values"]
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    old = rows.filter(F.col("trans_date_trans_time") < middle).drop(*added)
    new = rows.filter(F.col("trans_date_trans_time") >= middle)
    return union_evolving(old, new).select("trans_num", *added)


@query("aligned_schema", "K7")
def _(spark, sf_dir):
    raw = fixture.raw_transactions(spark, sf_dir)
    return align_schema(raw).select("trans_num", "amt", "prediction", "fast_pass_score", "prediction_latency_ms", "shap_values")


@query("alert_outbox", "K8 F7 F8 F9 F10 F11 F20")
def _(spark, sf_dir):
    return alerts.read_payloads(alerts.alert_payloads(fact(spark, sf_dir)))


@query("built_marts", "K6")
def _(spark, sf_dir):
    path = scratch_path(spark, "gold")
    names = warehouse.build_marts(fact(spark, sf_dir), path=path)
    counts = [
        spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("mart"), "n_rows")
        for name in names
    ]
    return training.union_all(counts)


# ---- projections and filters -------------------------------------------------------


@query("staging_view", "P1")
def _(spark, sf_dir):
    return staged(spark, sf_dir)


@query("cyclic_time", "P2 F2 F3")
def _(spark, sf_dir):
    return ft.cyclic_time(fact(spark, sf_dir)).select("trans_num", *ft.TIME_FEATURES)


@query("cyclic_decimal_hour", "P2b")
def _(spark, sf_dir):
    return ft.cyclic_time(fact(spark, sf_dir), decimal_hour=True).select("trans_num", *ft.TIME_FEATURES)


@query("cyclic_round_trip", "F5")
def _(spark, sf_dir):
    c = F.col
    return ft.cyclic_time(fact(spark, sf_dir)).select(
        "trans_num",
        fn.decode_cycle(c("hour_sin"), c("hour_cos"), 24).alias("hour"),
        fn.decode_cycle(c("weekday_sin"), c("weekday_cos"), 7).alias("weekday"),
        fn.decode_month(c("month_sin"), c("month_cos")).alias("month"),
    )


@query("purchase_distance", "P3")
def _(spark, sf_dir):
    rows = ft.purchase_distance(fact(spark, sf_dir))
    return rows.select("trans_num", F.round("distance_achat", 4).alias("distance_achat"))


@query("customer_age", "P4 F19")
def _(spark, sf_dir):
    dob, ts = F.col("dob"), F.col("trans_date_trans_time")
    return fact(spark, sf_dir).select(
        "trans_num",
        fn.age(dob).alias("age_2020"),
        fn.age(dob, as_of_year=2024).alias("age_as_of_2024"),
        fn.age(dob, ts, "transaction_year").alias("age_at_transaction"),
        fn.age(dob, ts, "elapsed").alias("age_elapsed"),
        fn.age(F.when(F.col("gender") == "F", dob), ts, "elapsed").alias("age_with_default"),
    )


@query("unit_sphere", "P5")
def _(spark, sf_dir):
    return ft.cartesian(fact(spark, sf_dir)).select("trans_num", *ft.CLIENT_XYZ, *ft.MERCHANT_XYZ)


@query("geo_cells", "P6")
def _(spark, sf_dir):
    return ft.cells(fact(spark, sf_dir), 0.25).select("trans_num", *ft.CELLS)


@query("geo_feature_modes", "P7")
def _(spark, sf_dir):
    rows = ft.engineered(fact(spark, sf_dir))
    parts = []
    for mode in ("none", "raw", "cartesian", "h3"):
        frame, names = ft.geo_features(rows, mode)
        parts.append(
            frame.select(*names).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(mode).alias("geo_mode"), F.lit(len(names)).alias("n_features"), "category", "n_rows"
            )
        )
    return training.union_all(parts)


@query("on_demand_features", "P8 F19")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    gone = F.col("category") == "error"
    requests = rows.select(
        "trans_num",
        F.when(~gone, F.col("category")).alias("category"),
        F.when(~gone, F.col("amt")).alias("amt"),
        F.when(F.col("category") == "click", F.lit("not a time"))
        .otherwise(F.date_format("trans_date_trans_time", "yyyy-MM-dd HH:mm:ss"))
        .alias("trans_date_trans_time"),
        "lat", "long", "merch_lat", "merch_long",
        F.when(~gone, F.col("gender")).alias("gender"),
        F.when(F.col("category") == "signup", F.lit("1999-99-99")).otherwise(F.col("dob").cast("string")).alias("dob"),
        F.when(~gone, F.col("city_pop")).alias("city_pop"),
    )
    derived = ft.on_demand_features(requests)
    wide = [f.name for f in derived.schema.fields if isinstance(f.dataType, T.FloatType)]
    return derived.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in wide})


@query("model_features", "P9")
def _(spark, sf_dir):
    return ft.model_features(ft.engineered(fact(spark, sf_dir)))


@query("feature_sets", "P10")
def _(spark, sf_dir):
    rows = ft.cells(ft.cartesian(ft.engineered(fact(spark, sf_dir))))
    parts = []
    for name, columns in ft.FEATURE_SETS.items():
        present = ft.project(rows, name).agg(*[F.count(c).alias(c) for c in columns])
        filled = sum((F.col(c) for c in columns), F.lit(0))
        parts.append(present.select(F.lit(name).alias("feature_set"), F.lit(len(columns)).alias("n_features"), filled.alias("filled_values")))
    return training.union_all(parts)


@query("outlier_cut", "P11 J5")
def _(spark, sf_dir):
    return filters.outlier_filter(fact(spark, sf_dir), 0.5).select("trans_num", "amt")


@query("blocked_transactions", "P12 F8")
def _(spark, sf_dir):
    return warehouse.mart_merchant_blocked_transactions(staged(spark, sf_dir))


@query("time_range", "P13")
def _(spark, sf_dir):
    return filters.between_time(fact(spark, sf_dir), "2024-01-05", "2024-01-12 06:30:00").select("trans_num", "trans_date_trans_time")


@query("first_days", "P14")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    closed, open_ended = (filters.first_days(rows, 10, inclusive=i).agg(F.count(F.lit(1)).alias("n")) for i in (True, False))
    return closed.select(F.col("n").alias("inclusive_rows"), open_ended.scalar().alias("exclusive_rows"))


@query("last_day_window", "P15")
def _(spark, sf_dir):
    return filters.last_window(fact(spark, sf_dir), 24).select("trans_num", "trans_date_trans_time")


@query("in_list", "P16")
def _(spark, sf_dir):
    return filters.members(staged(spark, sf_dir), "transaction_category", ["error", "signup"]).select(
        "transaction_id", "transaction_category"
    )


@query("report_scope", "P17 J4")
def _(spark, sf_dir):
    metrics_by_day = durable(daily(spark, sf_dir), "daily")
    critical = reports.pareto(metrics_by_day)
    return filters.resolve_scope(metrics_by_day, None, critical).select("transaction_date", "merchant_name", "total_transactions")


@query("report_scope_one_merchant", "P17")
def _(spark, sf_dir):
    return filters.resolve_scope(daily(spark, sf_dir), "m5", None).select("transaction_date", "merchant_name", "total_transactions")


@query("point_lookup", "P18")
def _(spark, sf_dir):
    return filters.lookup(fact(spark, sf_dir), "t123").select(
        "trans_num", fn.card_hash(F.col("cc_num")).alias("cc_num_sha256"), "amt", "category", "merchant", "prediction", "prediction_proba", "shap_values"
    )


def payment_requests(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("trans_num").alias("transaction_id"),
        F.when(F.col("category") != "error", F.col("cc_num").cast("string")).alias("user_id"),
        (F.col("amt").cast("double") - 20.0).alias("amount"),
        F.lit("192.0.2.1").alias("ip_address"),
        F.when(F.col("gender") == "F", F.lit("FRA")).otherwise(F.col("state")).alias("country"),
    )


@query("request_validation", "P19")
def _(spark, sf_dir):
    return filters.validate(payment_requests(fact(spark, sf_dir))).select("transaction_id", "is_valid", "reject_reason")


@query("threshold_scorer", "P20")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir).select("trans_num", (F.col("amt") * 40).alias("amount"))
    return filters.simple_score(rows)


@query("name_functions", "F12 F13 F14 F16 F17")
def _(spark, sf_dir):
    encoded = F.concat(F.lit("onehot__category_"), F.col("category"))
    run = F.concat(F.initcap("category"), F.lit("_Sampling_"), F.col("is_fraud") * 5, F.when(F.col("gender") == "F", "pc").otherwise(""))
    limits = F.create_map(F.lit("amt_max"), F.col("amt"))
    return fact(spark, sf_dir).select(
        "trans_num",
        fn.strip_prefix(fn.leaf_name(encoded), "category_").alias("category"),
        fn.run_model_type(run).alias("model_type"),
        fn.run_ratio(run).alias("ratio"),
        fn.underscored(F.concat("merchant", F.lit(" "), "job")).alias("file_part"),
        fn.version_label(F.col("fast_pass_score").cast("string")).alias("version"),
        fn.map_get(limits, "amt_max", F.lit(0).cast("decimal(10,2)")).alias("known_limit"),
        fn.map_get(limits, "age_max", F.lit(38).cast("decimal(10,2)")).alias("default_limit"),
        fn.iso_utc(F.col("trans_date_trans_time")).alias("iso"),
        fn.percent_text(F.col("prediction_proba")).alias("probability"),
        fn.card_hash(F.col("cc_num"), 16).alias("card"),
    )


# ---- rules -------------------------------------------------------------------------


@query("fast_pass_score", "R1 F15 F16")
def _(spark, sf_dir):
    rows = ft.engineered(fixture.raw_transactions(spark, sf_dir))
    return rules.fast_pass(rows, fixture.fixture_rules(spark)).select("trans_num", "fast_pass_score", "fast_pass_suspicion")


@query("fast_pass_without_rules", "R1")
def _(spark, sf_dir):
    rows = ft.engineered(fixture.raw_transactions(spark, sf_dir))
    none = fixture.fixture_rules(spark).limit(0)
    return rules.fast_pass(rows, none).select("trans_num", "fast_pass_score", "fast_pass_suspicion")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.contributions(fact(spark, sf_dir))


@query("mined_thresholds", "R2")
def _(spark, sf_dir):
    return rules.mine_thresholds(contributions(spark, sf_dir))


@query("mined_categories", "R3")
def _(spark, sf_dir):
    return rules.mine_categories(contributions(spark, sf_dir))


@query("mined_positions", "R4")
def _(spark, sf_dir):
    return rules.mine_cyclic(contributions(spark, sf_dir))


@query("mined_rules_all_columns", "R5")
def _(spark, sf_dir):
    return rules.mine_all(contributions(spark, sf_dir))


@query("rules_document", "R6 S9 K5")
def _(spark, sf_dir):
    path = scratch_path(spark, "rules")
    document = retrain.mine_rules(contributions(spark, sf_dir))
    sinks.write_json(document, path)
    found = files.read_rules(spark, path)
    return found.select(
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("thresholds")))).alias("thresholds"),
        *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in found.columns if c != "thresholds"],
    )


# ---- joins and history -----------------------------------------------------------------


@query("online_enrichment", "J2 W5")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    # the female customers' cards are known to the store, the others are new cards
    known = rows.filter("gender = 'F'")
    requests = rows.select("trans_num", "cc_num", "amt")
    return history.enrich(requests, known)


@query("point_in_time_enrichment", "J2")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    suspicious = rows.filter("fast_pass_suspicion = 1").withColumn("logged_at", F.expr("trans_date_trans_time + INTERVAL 1 HOUR"))
    requests = rows.select("trans_num", "cc_num", F.col("trans_date_trans_time").alias("requested_at"))
    found = history.enrich_as_of(requests, suspicious, "trans_num", "requested_at", ("amt", "fast_pass_score"), ttl_days=3)
    return found.select("trans_num", "amt", "fast_pass_score")


@query("merged_alerts", "J6 U3 W6")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    recent = alerts.alert_history(rows)
    cache = recent.filter("category <> 'view'").withColumn("verdict", F.lit("cached"))
    return alerts.merge_alerts(cache, recent).select("transaction_id", "merchant", "amount", "verdict", "probability")


@query("latest_by_card", "W5")
def _(spark, sf_dir):
    return history.latest_by_key(fact(spark, sf_dir), "cc_num", "logged_at", "trans_num").select("cc_num", "trans_num", "logged_at", "city_pop")


@query("neighbour_mean", "W4")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir).select("trans_num", "cc_num", "amt", "prediction_proba")
    return history.neighbour_mean(rows, ["amt", "prediction_proba"]).select("trans_num", "nb_amt", "nb_prediction_proba")


@query("velocity_features", "A20")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir).select("trans_num", "cc_num", "trans_date_trans_time", "amt", "is_fraud")
    return history.velocity_features(rows).select("trans_num", "count_1h", "sum_24h", "avg_7d", "is_fraud")


# ---- aggregations and reports ----------------------------------------------------------


@query("merchant_daily_metrics", "A1")
def _(spark, sf_dir):
    return daily(spark, sf_dir)


@query("merchant_hourly_fraud", "A2")
def _(spark, sf_dir):
    return warehouse.mart_merchant_hourly_fraud(staged(spark, sf_dir))


@query("fast_pass_performance", "A3")
def _(spark, sf_dir):
    return warehouse.mart_fast_pass_performance(staged(spark, sf_dir))


@query("merchant_attributions", "A4 F4 F6")
def _(spark, sf_dir):
    return warehouse.mart_merchant_shap_importance(staged(spark, sf_dir))


@query("operational_sla", "A5")
def _(spark, sf_dir):
    return warehouse.mart_operational_sla(staged(spark, sf_dir))


@query("global_stats", "A6")
def _(spark, sf_dir):
    return reports.global_stats(fact(spark, sf_dir))


@query("day_over_day", "A7")
def _(spark, sf_dir):
    return reports.day_over_day(fact(spark, sf_dir))


@query("confusion_matrix", "A8")
def _(spark, sf_dir):
    return metrics.confusion_matrix(fact(spark, sf_dir))


@query("classification_metrics", "A9")
def _(spark, sf_dir):
    return metrics.classification_metrics(metrics.confusion_matrix(fact(spark, sf_dir)))


@query("roc_auc", "A10")
def _(spark, sf_dir):
    return metrics.roc_auc(fact(spark, sf_dir))


@query("merchant_summary", "A11")
def _(spark, sf_dir):
    return reports.merchant_summary(daily(spark, sf_dir))


@query("hourly_summary", "A12")
def _(spark, sf_dir):
    return reports.hourly_summary(warehouse.mart_merchant_hourly_fraud(staged(spark, sf_dir)))


@query("attribution_summary", "A13")
def _(spark, sf_dir):
    return reports.attribution_summary(warehouse.mart_merchant_shap_importance(staged(spark, sf_dir)))


@query("distinct_merchants", "A14")
def _(spark, sf_dir):
    return reports.distinct_values(daily(spark, sf_dir), "merchant_name")


@query("distinct_blocked_categories", "A14")
def _(spark, sf_dir):
    return reports.distinct_values(warehouse.mart_merchant_blocked_transactions(staged(spark, sf_dir)), "transaction_category")


@query("resume_point", "A15")
def _(spark, sf_dir):
    return reports.resume_point(fact(spark, sf_dir))


@query("row_count", "A16")
def _(spark, sf_dir):
    return reports.row_count(fact(spark, sf_dir))


@query("latency_summary", "A17")
def _(spark, sf_dir):
    return metrics.latency_summary(fact(spark, sf_dir))


def runs_by_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records derived from the fact: one per merchant, experiments by category."""
    matrix = fact(spark, sf_dir).groupBy("category", "merchant").agg(
        *[
            F.count(F.when((F.col("is_fraud") == y) & (F.col("prediction") == p), 1)).alias(name)
            for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ],
        F.min("trans_date_trans_time").alias("start_time"),
    )
    figures = metrics.classification_metrics(matrix)
    odd = F.col("merchant").isin("m1", "m3", "m5", "m7")

    def named(name: str, value: str) -> list:
        return [F.lit(name), F.col(value)]

    full = F.create_map(
        *named("prec_class_1", "prec_class_1"), *named("rec_class_1", "rec_class_1"), *named("f1_class_1", "f1_class_1"),
        *named("f2_class_1", "f2_class_1"), *named("F1_global", "F1_global"), *named("recall_global", "recall_global"),
    )
    old = F.create_map(*named("precision", "prec_class_1"), *named("recall", "rec_class_1"), *named("f1_score", "f1_class_1"), *named("f2_score", "f2_class_1"))
    return figures.select(
        F.col("category").alias("experiment"),
        F.concat_ws("-", "category", "merchant").alias("run_id"),
        F.concat(F.initcap("category"), F.lit("_Sampling_5pc")).alias("run_name"),
        "start_time",
        F.when(odd, old).otherwise(full).alias("metrics"),
    )


@query("best_run", "A18 F16")
def _(spark, sf_dir):
    return metrics.best_run(runs_by_merchant(spark, sf_dir)).drop("summary")


@query("leaderboard", "A21 F12")
def _(spark, sf_dir):
    return metrics.leaderboard(runs_by_merchant(spark, sf_dir), "click-m10")


@query("champion_run", "M14")
def _(spark, sf_dir):
    runs = runs_by_merchant(spark, sf_dir).withColumn("champion", F.lit(None).cast("boolean"))
    return metrics.champion_run(runs).select("run_id", "experiment", "start_time")


@query("alert_counts", "A19")
def _(spark, sf_dir):
    return alerts.alert_counts(alerts.alert_history(fact(spark, sf_dir)), "m5")


@query("pareto_merchants", "W1 L1")
def _(spark, sf_dir):
    return reports.pareto(durable(daily(spark, sf_dir), "daily"))


@query("pareto_summary", "W2")
def _(spark, sf_dir):
    by_day = durable(daily(spark, sf_dir), "daily")
    return reports.pareto_summary(reports.pareto(by_day), by_day)


@query("most_fraudulent_merchant", "L4")
def _(spark, sf_dir):
    return reports.most_fraudulent(reports.pareto(durable(daily(spark, sf_dir), "daily")))


@query("latest_suspicious", "L2 L1")
def _(spark, sf_dir):
    return reports.latest_suspicious(fact(spark, sf_dir), "m5", 50).select("trans_num", "trans_date_trans_time", "amt", "merchant")


@query("latest_blocked", "L3 L1")
def _(spark, sf_dir):
    return reports.latest_blocked(warehouse.mart_merchant_blocked_transactions(staged(spark, sf_dir)), 100)


@query("transaction_detail", "P18 F10")
def _(spark, sf_dir):
    return reports.transaction_card(fact(spark, sf_dir), "t123")


@query("alert_feed", "T4 T7")
def _(spark, sf_dir):
    outbox = alerts.alert_payloads(fact(spark, sf_dir))
    return alerts.alert_feed(outbox).select("trans_num", "alert_ts")


# ---- sampling --------------------------------------------------------------------------


def by_class(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "is_fraud").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trans_num").alias("n_distinct"))


@query("sample_exact_n", "L5")
def _(spark, sf_dir):
    sample = sampling.sample_n(fact(spark, sf_dir), 500)
    return sample.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("trans_num").alias("n_distinct"))


@query("rebalanced", "L6 U2")
def _(spark, sf_dir):
    return by_class(sampling.rebalance(fact(spark, sf_dir), 0.2))


@query("undersampled", "L7 U2")
def _(spark, sf_dir):
    return by_class(sampling.undersample(fact(spark, sf_dir)))


@query("oversampled", "L8 U2")
def _(spark, sf_dir):
    return sampling.oversample(fact(spark, sf_dir)).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stratified_split", "L9")
def _(spark, sf_dir):
    train, test = sampling.stratified_split(fact(spark, sf_dir), 0.3)
    return by_class(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))), "part")


@query("balanced_sample", "L10 U2")
def _(spark, sf_dir):
    return by_class(sampling.balanced_sample(fact(spark, sf_dir), {0: 800, 1: 200}))


@query("hybrid_sample", "L11 U2")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    recent = filters.last_window(rows, 30 * 24).filter("category = 'error'").withColumn("origin", F.lit("recent"))
    reference = rows.filter("category <> 'error'").withColumn("origin", F.lit("reference"))
    return by_class(sampling.hybrid_sample(recent, reference, {0: 800, 1: 200}), "origin")


@query("head_and_tail", "L12")
def _(spark, sf_dir):
    return sampling.head_tail(fact(spark, sf_dir), 300, "trans_date_trans_time", "trans_num").select("part", "trans_num")


@query("stratified_folds", "L13")
def _(spark, sf_dir):
    return by_class(sampling.stratified_folds(fact(spark, sf_dir), 5), "fold")


# ---- drift -----------------------------------------------------------------------------

DRIFT_DAY = "2024-01-30"


def drift_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.purchase_distance(ft.cyclic_time(fact(spark, sf_dir)))
    return rows.select("trans_num", "trans_date_trans_time", *drift.NUMERIC, *drift.CATEGORICAL)


@query("drift_windows", "T6")
def _(spark, sf_dir):
    return drift.drift_windows(fact(spark, sf_dir), DRIFT_DAY).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))


@query("wasserstein_drift", "D1 W3")
def _(spark, sf_dir):
    return drift.wasserstein(drift.drift_windows(drift_input(spark, sf_dir), DRIFT_DAY))


@query("jensen_shannon_drift", "D2")
def _(spark, sf_dir):
    return drift.js_distance(drift.drift_windows(drift_input(spark, sf_dir), DRIFT_DAY))


@query("drift_flags", "D3")
def _(spark, sf_dir):
    return drift.column_drift(drift.drift_windows(drift_input(spark, sf_dir), DRIFT_DAY)).select("column_name", "method", "drift_detected")


@query("drift_verdict", "D4")
def _(spark, sf_dir):
    return drift.drift_report(drift_input(spark, sf_dir), DRIFT_DAY)[0]


@query("needs_retrain", "D6")
def _(spark, sf_dir):
    return drift.needs_retrain(drift.drift_report(drift_input(spark, sf_dir), DRIFT_DAY)[0])


@query("drift_head_tail", "D5 L12")
def _(spark, sf_dir):
    rows = drift_input(spark, sf_dir)
    tagged = sampling.head_tail(rows, 1000, "trans_date_trans_time", "trans_num")
    return drift.drift_head_tail(durable(tagged, "head-tail"))


@query("head_tail_statistics", "D5 L12")
def _(spark, sf_dir):
    tagged = sampling.head_tail(drift_input(spark, sf_dir), 1000, "trans_date_trans_time", "trans_num")
    return drift.small_sample_statistics(durable(tagged, "head-tail")).drop("freedom")


@query("drift_report_file", "S10 K5 D4")
def _(spark, sf_dir):
    path = scratch_path(spark, "drift")
    verdict, details = drift.drift_report(drift_input(spark, sf_dir), DRIFT_DAY)
    one = F.struct("drift_detected", "metric_value", "threshold", "method")
    entries = details.agg(F.map_from_entries(F.collect_list(F.struct("column_name", one))).alias("d")).scalar()
    sinks.write_json(verdict.withColumn("details", entries), path)
    report = files.flatten_drift(spark.read.text(path), F.col("value"))
    return report.select("current_date", "sample_size", "column_name", "drift_detected", "method", "threshold")


# ---- training and explanation --------------------------------------------------------------

def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(ft.engineered(fixture.raw_transactions(spark, sf_dir)), "training")


@query("boosted_trees", "M1 M3 M12")
def _(spark, sf_dir):
    train, test = sampling.stratified_split(training_rows(spark, sf_dir), 0.3)
    return training.evaluate(test, training.train_gbt(train), "boosted_trees")


@query("balanced_boosted_trees", "M4")
def _(spark, sf_dir):
    train, test = sampling.stratified_split(training_rows(spark, sf_dir), 0.3)
    return training.evaluate(test, training.train_gbt(train, balanced=True), "balanced_boosted_trees")


@query("logistic_regression", "M2 M5")
def _(spark, sf_dir):
    train, test = sampling.stratified_split(training_rows(spark, sf_dir), 0.2)
    return training.evaluate(test, training.train_lr(train, balanced=True), "logistic_regression")


@query("random_forest", "M6")
def _(spark, sf_dir):
    train, test = sampling.stratified_split(training_rows(spark, sf_dir), 0.2)
    return training.evaluate(test, training.train_rf(train), "random_forest")


@query("neighbour_shares", "W4 M7 M8")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir).select("trans_num", "cc_num", *training.INDEXED_TEXT)
    graph, names = training.with_neighbourhood(rows, training.INDEXED_TEXT)
    return graph.unpivot("trans_num", names, "feature", "share")


@query("graph_linear", "M7")
def _(spark, sf_dir):
    graph, names = training.with_neighbourhood(training_rows(spark, sf_dir))
    train, test = sampling.stratified_split(durable(graph, "graph"), 0.3)
    return training.evaluate(test, training.train_graph_lr(train, names), "graph_linear")


@query("graph_boosted_trees", "M8")
def _(spark, sf_dir):
    graph, _ = training.with_neighbourhood(training_rows(spark, sf_dir))
    train, test = sampling.stratified_split(durable(graph, "graph"), 0.3)
    return training.evaluate(test, training.train_graph_gbt(train), "graph_boosted_trees")


@query("cross_validation", "M15")
def _(spark, sf_dir):
    return training.cross_validate(training_rows(spark, sf_dir))


@query("hyper_parameter_search", "M9")
def _(spark, sf_dir):
    return training.search(training_rows(spark, sf_dir)).trials.drop("params")


@query("search_parts", "M9 L9 L13")
def _(spark, sf_dir):
    """Rows a class in each fold and in the test part of the search: every labelled row is in one of them."""
    shared = training.search_rows(training_rows(spark, sf_dir))
    parts = shared.vectors.select("fold", "is_fraud").unionByName(shared.test.select(F.lit(-1).alias("fold"), "is_fraud"))
    return parts.groupBy("fold", "is_fraud").agg(F.count(F.lit(1)).alias("n_rows"))


@query("promoted_runs", "M9 M12 M14")
def _(spark, sf_dir):
    """Two runs are stored, the second no better; the champion is read back and its stored model scores the test rows."""
    registry = champions.Registry(spark, scratch_path(spark, "registry"))
    train, test = (durable(part, "split") for part in sampling.stratified_split(training_rows(spark, sf_dir), 0.3))
    model = training.train_lr(train)
    figure = training.evaluate(test, model, "linear").first()["f2_class_1"] or 0.0
    started = test.agg(F.max("trans_date_trans_time")).first()[0]
    for name in ("first", "second"):
        registry.challenge(registry.record("promotion", name, model, {"f2_class_1": figure}, {}, started), figure)
    stored, version = registry.champion_model()
    scored = training.score(test, stored, version)
    tested = scored.agg(F.count_if(F.col("is_fraud") == 1).alias("n_fraud"), F.count_if(F.col("is_fraud") == 0).alias("n_clean"), F.max("model_version").alias("v"))
    columns = [tested.select(c).scalar().alias(name) for c, name in (("n_fraud", "n_fraud"), ("n_clean", "n_clean"), ("v", "model_version"))]
    return registry.runs().select("experiment", "run_name", "champion", *columns)


@query("feature_set_sweep", "M10 P10")
def _(spark, sf_dir):
    return training.sweep(fixture.raw_transactions(spark, sf_dir), parallelism=8)


@query("sampling_sweep", "M11")
def _(spark, sf_dir):
    return training.sampling_sweep(fixture.raw_transactions(spark, sf_dir), parallelism=8)


@query("initial_model", "M13 P14")
def _(spark, sf_dir):
    return training.train_initial(fixture.raw_transactions(spark, sf_dir))[1]


# An example linear model for the attribution queries.
WEIGHTS = {
    "amt": explain.Weight(0.8, 70.0, 50.0),
    "distance_achat": explain.Weight(0.3, 75.0, 25.0),
    "age": explain.Weight(0.1, 50.0, 20.0),
    "city_pop": explain.Weight(-0.2, 10000.0, 5000.0),
    "hour_sin": explain.Weight(-0.4, 0.0, 0.5),
    "hour_cos": explain.Weight(0.25, 0.0, 0.5),
    "category_error": explain.Weight(0.5, 0.25, 0.5),
}


def linear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.contribution_rows(ft.engineered(fact(spark, sf_dir)), WEIGHTS)


@query("selective_attributions", "N1 T7")
def _(spark, sf_dir):
    rows = explain.attribute(ft.engineered(fact(spark, sf_dir)), WEIGHTS)
    document = F.from_json("shap_values", "map<string,double>")
    return rows.select("trans_num", *[document[c].alias(f"{c}_contribution") for c in explain.REPORTED])


@query("global_importance", "N2")
def _(spark, sf_dir):
    return explain.global_importance(linear_rows(spark, sf_dir))


@query("contribution_curve", "N3")
def _(spark, sf_dir):
    return explain.contribution_curve(linear_rows(spark, sf_dir), "amt", 10.0)


@query("local_explanation", "N4")
def _(spark, sf_dir):
    return explain.local_explanation(linear_rows(spark, sf_dir), "t123")


@query("fitted_attributions", "N1 M5 R6")
def _(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    weights = explain.linear_weights(training.train_lr(rows, balanced=True))
    return explain.global_importance(explain.contribution_rows(rows, weights))


@query("daily_cycle", "D4 D6 M9 R6")
def _(spark, sf_dir):
    cycle = retrain.daily_cycle(fixture.raw_transactions(spark, sf_dir), DRIFT_DAY)
    document = cycle.rules.select(F.to_json(F.struct("*")).alias("rules"))
    return cycle.verdict.select("current_date", "drift_detected", document.scalar().alias("rules"))


# ---- streams ---------------------------------------------------------------------------


@query("time_slices", "T5 F14")
def _(spark, sf_dir):
    rows = fact(spark, sf_dir)
    start = F.lit("2024-01-03 05:00:00").cast("timestamp_ntz")
    cut = queue.slice_bins(rows, start, 7 * history.DAY, 13)
    return cut.groupBy("bin_number", "file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amt").alias("volume"))


def drained(spark: SparkSession, sf_dir: str, registry: champions.Registry | None = None, raw: DataFrame | None = None) -> dict[str, str]:
    """Cut the raw rows into queue files, drain them as a stream, return the output folders.

    The rows are scored by the registry's champion, or by the amount alone where there is no registry; `raw` are the raw
    rows of the tables where they are stored already.
    """
    base = scratch_path(spark, "queue")
    where = {name: f"{base}/{name}" for name in ("files", "fact", "outbox", "ledger", "checkpoint")}
    raw = fixture.raw_transactions(spark, sf_dir) if raw is None else raw
    queue.write_queue(queue.slice_bins(raw, *queue.whole_days(raw), 4), where["files"])

    def scorer(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "prediction": F.when(F.col("amt") > 150, 1).otherwise(0),
                "prediction_proba": (F.least(F.col("amt"), F.lit(500)) / 500).cast("decimal(5,4)"),
                "model_version": fn.version_label(1),
            }
        )

    def start_query():
        chosen = queue.pinned_scorer(registry, where["checkpoint"]) if registry else scorer
        return queue.run_queue(
            spark, where["files"], where["fact"], where["checkpoint"], where["outbox"], where["ledger"],
            fixture.fixture_rules(spark), chosen, WEIGHTS, files_per_batch=32,
        )

    start_query().awaitTermination()
    return where


@query("queue_by_champion", "T2 M12")
def _(spark, sf_dir):
    """The queue scored by a stored champion: how many rows have the class and probability that scoring the whole table gives."""
    registry = champions.Registry(spark, scratch_path(spark, "registry"))
    rows = training_rows(spark, sf_dir)
    model = training.train_lr(rows)
    started = rows.agg(F.max("trans_date_trans_time")).first()[0]
    registry.challenge(registry.record("queue", "linear", model, {}, {}, started), 0.5)
    streamed = sinks.read_scored(spark, drained(spark, sf_dir, registry, rows)["fact"]).select("trans_num", "prediction", "prediction_proba", "model_version")
    batch = training.score(rows, model, 1).select("trans_num", F.col("prediction").alias("p"), F.col("prediction_proba").alias("q"))
    same = (F.col("prediction") == F.col("p")) & (F.col("prediction_proba") == F.col("q"))
    joined = streamed.join(batch, "trans_num", "full")
    return joined.groupBy("model_version").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_equal"))


@query("queue_drain", "S8 T1 T2 T3 K1")
def _(spark, sf_dir):
    scored = sinks.read_scored(spark, drained(spark, sf_dir)["fact"])
    return scored.select("trans_num", "amt", "prediction", "fast_pass_score", "fast_pass_suspicion", "model_version", F.col("shap_values").isNotNull().alias("attributed"))


@query("queue_alerts", "T1 K8")
def _(spark, sf_dir):
    return alerts.read_payloads(spark.read.parquet(drained(spark, sf_dir)["outbox"])).select("transaction_id", "amount", "verdict")


@query("queue_ledger", "T1 K2")
def _(spark, sf_dir):
    ledger = spark.read.parquet(drained(spark, sf_dir)["ledger"])
    return ledger.agg(F.count_distinct("file_name").alias("n_files"), F.sum("n_rows").alias("n_rows"))


def fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = fixture.raw_from_events(events, customer)
    return fixture.score_fixture(raw, fixture.fixture_rules(spark))


def run_live(start, stream: DataFrame, label: str) -> str:
    """Run a live table over what is there now; the folder of its batches."""
    base = scratch_path(stream.sparkSession, label)
    start(stream, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return f"{base}/rows"


@query("live_daily_metrics", "T4 A1")
def _(spark, sf_dir):
    return queue.read_daily_metrics(spark, run_live(queue.live_daily_metrics, fact_stream(spark, sf_dir), "live-daily"))


@query("live_alerts", "T3 T4 K8")
def _(spark, sf_dir):
    return queue.read_alerts(spark, run_live(queue.live_alerts, fact_stream(spark, sf_dir), "live-alerts")).select("trans_num", "alert_ts")
