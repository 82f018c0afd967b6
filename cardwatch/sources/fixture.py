"""The scored-transaction fact derived from the event and customer tables.

Whole-number arithmetic on ids, so any engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch import functions as fn
from cardwatch.operators.features import POSITIONS
from cardwatch.operators.rules import attribution_rows, fast_pass
from cardwatch.schema import RULES

# The rule document of the derived fact.
FIXTURE_RULES = {
    "thresholds": {"amt_max": 150.0, "distance_achat_max": 100.0, "age_max": 38.0, "city_pop_max": 3600.0},
    "suspicious_categories": ["error", "signup"],
    "suspicious_hours": [3, 22, 23],
    "suspicious_weekdays": [5, 6],
    "suspicious_months": [],
}
# Multipliers that spread attributions over -1.000 .. 1.000.
ATTRIBUTION_STEPS = {"amt": 17, "distance_achat": 23, "age": 29, "city_pop": 41, "hour_sin": 43, "hour_cos": 47}


RAW_SQL = """
  ts AS trans_date_trans_time
  user_id + 4000000000000000 AS cc_num
  concat('m', (user_id * 7 + event_id) % 37) AS merchant
  event_type AS category
  CAST(value AS DECIMAL(10,2)) AS amt
  split_part(c_name, '#', 1) AS first
  split_part(c_name, '#', 2) AS last
  IF(user_id % 2 = 0, 'F', 'M') AS gender
  concat(user_id % 90 + 1, ' Main Street') AS street
  concat('city', user_id % 200) AS city
  concat('state', user_id % 50) AS state
  CAST(user_id * 37 % 90000 + 10000 AS INT) AS zip
  {lat} AS lat
  {long} AS long
  CAST(user_id * 6151 % 20000 + 100 AS INT) AS city_pop
  c_mktsegment AS job
  make_date(CAST(user_id % 60 + 1940 AS INT), CAST(user_id % 12 + 1 AS INT), CAST(user_id % 28 + 1 AS INT)) AS dob
  concat('t', event_id) AS trans_num
  CAST(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000) AS BIGINT) AS unix_time
  {merch_lat} AS merch_lat
  {merch_long} AS merch_long
  IF(event_id % 13 = 0, 1, 0) AS is_fraud
  event_id
"""


def scaled(whole: str, digits: int, kind: str) -> str:
    """A whole number with the decimal point moved left."""
    return f"CAST(CAST({whole} AS DECIMAL(12,0)) * {10**-digits:.{digits}f}BD AS {kind})"


def fixture_rules(spark: SparkSession) -> DataFrame:
    limits = ", ".join(f"'{k}', {v}D" for k, v in FIXTURE_RULES["thresholds"].items())
    lists = [f"CAST(array({', '.join(map(repr, FIXTURE_RULES[f.name]))}) AS {f.dataType.simpleString()}) AS {f.name}" for f in RULES.fields[1:]]
    return spark.sql("SELECT 1").selectExpr(f"map({limits}) AS thresholds", *lists)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored rows: the raw layout plus the event id they come from."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return raw_from_events(events, customer)


def raw_from_events(events: DataFrame, customer: DataFrame) -> DataFrame:
    lat, lon = "user_id * 7919 % 2400 + 2500", "user_id * 104729 % 5000 - 12000"
    degrees = {
        "lat": scaled(lat, 2, "DECIMAL(10,6)"),
        "long": scaled(lon, 2, "DECIMAL(10,6)"),
        "merch_lat": scaled(f"{lat} + event_id * 13 % 200 - 100", 2, "DECIMAL(10,6)"),
        "merch_long": scaled(f"{lon} + event_id * 31 % 200 - 100", 2, "DECIMAL(10,6)"),
    }
    joined = events.join(customer, events["user_id"] == customer["c_custkey"])
    return joined.selectExpr(*[line.strip() for line in RAW_SQL.format(**degrees).strip().splitlines()])


def attribution(step: int) -> str:
    return scaled(f"event_id * {step} % 2001 - 1000", 3, "DECIMAL(10,3)")


def score_fixture(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Predictions, rule score and attributions derived from the event id."""
    predicted = "amt > 150 OR event_id % 26 = 0"
    share = f"event_id % 5000 + IF({predicted}, 5000, 0)"
    document = ", ',', ".join(f"""'"{key}":', {attribution(step)}""" for key, step in ATTRIBUTION_STEPS.items())
    scored = raw.selectExpr(
        "*",
        f"IF({predicted}, 1, 0) AS prediction",
        f"{scaled(share, 4, 'DECIMAL(5,4)')} AS prediction_proba",
        f"{scaled('event_id * 37 % 2500', 2, 'DECIMAL(10,4)')} AS prediction_latency_ms",
        "'fraud_detector_v1' AS model_version",
        "trans_date_trans_time AS logged_at",
    ).withColumns({"distance_achat": fn.haversine_km(*[F.col(c) for c in POSITIONS]), "age": fn.age(F.col("dob"))})
    return (
        fast_pass(scored, rules)
        .selectExpr("*", f"IF(prediction = 1 OR fast_pass_suspicion = 1, concat('{{', {document}, '}}'), NULL) AS shap_values")
        .drop("distance_achat", "age")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored fact at the scale of the given tables (keeps `event_id`)."""
    return score_fixture(raw_transactions(spark, sf_dir), fixture_rules(spark))


def contributions(scored: DataFrame) -> DataFrame:
    """Attribution rows for rule mining."""
    measured = scored.withColumns(
        {
            **fn.cyclic_columns(F.col("trans_date_trans_time")),
            "distance_achat": fn.staging_distance(*[F.col(c) for c in POSITIONS]),
            "age": fn.age(F.col("dob")),
        }
    )
    values = {c: c for c in ("amt", "distance_achat", "age", "city_pop")}
    values |= {f"category_{c}": f"category = '{c}'" for c in ("view", "signup", "error", "click", "purchase")}
    values |= {"gender_F": "gender = 'F'"}
    values |= {f"{part}_{wave}": f"{part}_{wave}" for part in ("hour", "weekday", "month") for wave in ("sin", "cos")}
    shares = [f"(event_id * {11 + 6 * place} % 2001 - 1000) / 1000D" for place in range(len(values))]
    return attribution_rows(measured, "trans_num", {name: (F.expr(value), F.expr(share)) for (name, value), share in zip(values.items(), shares)})
