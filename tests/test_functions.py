"""Column functions on hand-made rows."""

import datetime as dt
import hashlib
import math

from pyspark.sql import functions as F

from cardwatch import functions as fn


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_distance_between_two_cities(spark):
    km = one(spark, fn.haversine_km(F.lit(45.764043), F.lit(4.835659), F.lit(48.856614), F.lit(2.352222)))[0]
    assert 385.0 < km < 395.0


def test_distance_edges(spark):
    same, opposite, missing = one(
        spark,
        fn.haversine_km(F.lit(12.5), F.lit(30.25), F.lit(12.5), F.lit(30.25)),
        fn.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
        fn.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
    )
    assert same == 0.0
    assert math.isclose(opposite, math.pi * 6371.0)
    assert missing is None


def test_every_hour_weekday_and_month_survives_encoding(spark):
    hours = spark.range(24 * 400).select(F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0,0,0,0,CAST(id AS INT),0,0)").alias("ts"))
    encoded = hours.withColumns(fn.cyclic_columns(F.col("ts")))
    wrong = encoded.filter(
        (fn.decode_cycle(F.col("hour_sin"), F.col("hour_cos"), 24) != F.hour("ts"))
        | (fn.decode_cycle(F.col("weekday_sin"), F.col("weekday_cos"), 7) != F.weekday("ts"))
        | (fn.decode_month(F.col("month_sin"), F.col("month_cos")) != F.month("ts"))
    )
    assert wrong.count() == 0


def test_ages(spark):
    dob, ts = F.lit("1985-04-12").cast("date"), F.lit("2020-07-22 23:05:00").cast("timestamp_ntz")
    row = one(
        spark,
        fn.age(dob),
        fn.age(dob, as_of_year=2024),
        fn.age(dob, ts, "transaction_year"),
        fn.age(dob, ts, "elapsed"),
        fn.age(F.lit(None).cast("date"), ts, "elapsed"),
    )
    days = (dt.date(2020, 7, 22) - dt.date(1985, 4, 12)).days
    assert tuple(row) == (35, 39, 35, days / 365.25, 35.0)


def test_half_up_is_exact(spark):
    # 201 / 20000 of 100 is 1.005, which a double cannot hold
    row = one(spark, fn.percent(F.lit(201), F.lit(20000)), fn.percent(F.lit(1), F.lit(0)), fn.ratio_half_up(F.lit(1), F.lit(8), 2))
    assert [None if v is None else float(v) for v in row] == [1.01, None, 0.13]


def test_bad_text_becomes_null(spark):
    row = one(spark, fn.parse_date(F.lit("1999-99-99")), fn.parse_timestamp(F.lit("later")), fn.json_number(F.lit('{"a": "x"}'), "a"))
    assert tuple(row) == (None, None, None)


def test_card_hash(spark):
    row = one(spark, fn.card_hash(F.lit(4235789123451234567)), fn.card_hash(F.lit(423578912345), 16))
    assert row[0] == hashlib.sha256(b"4235789123451234567").hexdigest()
    assert row[1] == hashlib.sha256(b"423578912345").hexdigest()[:16]


def test_names(spark):
    row = one(
        spark,
        fn.leaf_name(F.lit("onehot__category_travel")),
        fn.strip_prefix(F.lit("category_travel"), "category_"),
        fn.strip_prefix(F.lit("travel"), "category_"),
        fn.run_ratio(F.lit("XGBoost_Sampling_10pc")),
        fn.run_ratio(F.lit("XGBoost")),
        fn.bin_file_name(F.lit(3), F.lit("2020-07-22 05:30:00").cast("timestamp_ntz")),
        fn.bin_file_name(F.lit(120), F.lit("2020-07-22 05:30:00").cast("timestamp_ntz")),
        fn.percent_text(F.lit(0.9962)),
    )
    assert tuple(row) == (
        "category_travel", "travel", "travel", "10", "N/A", "step_03_2020-07-22_05-30", "step_120_2020-07-22_05-30", "99.6200%",
    )


def test_list_contains_treats_missing_as_no(spark):
    row = one(spark, fn.list_contains(F.lit(None).cast("array<int>"), F.lit(1)), fn.list_contains(F.array(F.lit(1)), F.lit(1)))
    assert tuple(row) == (False, True)
