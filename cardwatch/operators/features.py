"""Feature columns and the named feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch import functions as fn

TIME_FEATURES = ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos"]
CLIENT_XYZ, MERCHANT_XYZ = ["x", "y", "z"], ["merch_x", "merch_y", "merch_z"]
CELLS = ["cell_client", "cell_merchant"]
POSITIONS = ["lat", "long", "merch_lat", "merch_long"]
BASE_FEATURES = ["category", "amt", "gender", "distance_achat", "age"]
MODEL_FEATURES = BASE_FEATURES + ["city_pop"] + TIME_FEATURES
MODEL_FEATURES_NO_CITY = BASE_FEATURES + TIME_FEATURES

# The column lists compared by the feature-set experiments.
_PERSONAL = ["merchant", "first", "last", "street", "zip", "job", "dob", "trans_num", "unix_time"]
_PLACE = ["city", "state"]
FEATURE_SETS: dict[str, list[str]] = {
    "raw_1_all_columns": BASE_FEATURES + TIME_FEATURES + _PERSONAL + _PLACE + ["city_pop"] + POSITIONS,
    "raw_2_no_personal_ids": BASE_FEATURES + TIME_FEATURES + _PLACE + ["city_pop"] + POSITIONS,
    "raw_3_no_state_city": BASE_FEATURES + TIME_FEATURES + ["city_pop"] + POSITIONS,
    "raw_4_no_city_pop": BASE_FEATURES + TIME_FEATURES + POSITIONS,
    "raw_5_only_state_city": BASE_FEATURES + TIME_FEATURES + _PLACE,
    "raw_6_only_city_pop": BASE_FEATURES + TIME_FEATURES + ["city_pop"],
}
for _kind, _extra in {"cartesian": CLIENT_XYZ + MERCHANT_XYZ, "cell": CELLS}.items():
    FEATURE_SETS |= {
        f"{_kind}_1_all_columns": BASE_FEATURES + TIME_FEATURES + _PERSONAL + _PLACE + ["city_pop"] + _extra,
        f"{_kind}_2_no_personal_ids": BASE_FEATURES + TIME_FEATURES + _PLACE + ["city_pop"] + _extra,
        f"{_kind}_3_no_state_city": BASE_FEATURES + TIME_FEATURES + ["city_pop"] + _extra,
        f"{_kind}_4_no_city_pop": BASE_FEATURES + TIME_FEATURES + _extra,
    }
# Text columns whose number of values grows with the data are hashed, not indexed.
UNBOUNDED_TEXT = {"merchant", "first", "last", "street", "job", "trans_num", *_PLACE, *CELLS}


def cyclic_time(df: DataFrame, ts: str = "trans_date_trans_time", decimal_hour: bool = False) -> DataFrame:
    return df.withColumns(fn.cyclic_columns(F.col(ts), decimal_hour))


def purchase_distance(df: DataFrame, name: str = "distance_achat") -> DataFrame:
    return df.withColumn(name, fn.haversine_km(*[F.col(c) for c in POSITIONS]))


def customer_age(df: DataFrame, mode: str = "as_of_year", as_of_year: int = 2020) -> DataFrame:
    return df.withColumn("age", fn.age(F.col("dob"), F.col("trans_date_trans_time"), mode, as_of_year))


def engineered(df: DataFrame, age_mode: str = "as_of_year", as_of_year: int = 2020) -> DataFrame:
    """All derived columns of the training and scoring path, in one projection."""
    return customer_age(purchase_distance(cyclic_time(df)), age_mode, as_of_year)


def model_features(df: DataFrame, with_city_pop: bool = True) -> DataFrame:
    return df.select(MODEL_FEATURES if with_city_pop else MODEL_FEATURES_NO_CITY)


def geo_features(
    df: DataFrame, mode: str = "none", cell_degrees: float = 0.1, city_pop_modes: tuple[str, ...] = ("raw", "cartesian", "h3")
) -> tuple[DataFrame, list[str]]:
    """(frame with the columns of a location encoding, the feature list that uses them).

    `city_pop_modes` names the encodings that also use the city population; the
    training scripts differ there: one adds it for `none` too, one not for `raw`.
    """
    if mode == "none":
        extra: list[str] = []
    elif mode == "raw":
        extra = POSITIONS
    elif mode == "cartesian":
        df, extra = cartesian(df), CLIENT_XYZ + MERCHANT_XYZ
    elif mode == "h3":
        df, extra = cells(df, cell_degrees), CELLS
    else:
        raise ValueError(f"unknown location encoding {mode!r}")
    return df, MODEL_FEATURES_NO_CITY + extra + (["city_pop"] if mode in city_pop_modes else [])


def cartesian(df: DataFrame) -> DataFrame:
    client = fn.latlon_to_xyz(F.col("lat"), F.col("long"))
    merchant = fn.latlon_to_xyz(F.col("merch_lat"), F.col("merch_long"))
    return df.withColumns(dict(zip(CLIENT_XYZ + MERCHANT_XYZ, client + merchant)))


def cells(df: DataFrame, degrees: float = 0.1) -> DataFrame:
    return df.withColumns(
        {
            "cell_client": fn.geo_cell(F.col("lat"), F.col("long"), degrees),
            "cell_merchant": fn.geo_cell(F.col("merch_lat"), F.col("merch_long"), degrees),
        }
    )


def project(df: DataFrame, feature_set: str) -> DataFrame:
    """The columns of a named feature set."""
    return df.select(FEATURE_SETS[feature_set])


# What a missing request field becomes.
REQUEST_DEFAULTS = {
    "text": "unknown",
    "number": 0.0,
    "dob": "1980-01-01",
    "time": "2020-01-01 00:00:00",
}


def on_demand_features(df: DataFrame, as_of_year: int = 2020) -> DataFrame:
    """Model inputs of request rows already joined to their card: 32-bit floats,
    defaults for what is missing, unreadable dates replaced."""

    def number(name: str, kind: str = "float") -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(REQUEST_DEFAULTS["number"]).cast(kind))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(REQUEST_DEFAULTS["text"]))

    born = F.coalesce(fn.parse_date(F.col("dob").cast("string")), F.lit(REQUEST_DEFAULTS["dob"]).cast("date"))
    paid = F.coalesce(
        fn.parse_timestamp(F.col("trans_date_trans_time").cast("string")),
        F.lit(REQUEST_DEFAULTS["time"]).cast("timestamp_ntz"),
    )
    kept = [c for c in ("cc_num", "trans_num") if c in df.columns]
    return df.select(
        *kept,
        text("category").alias("category"),
        number("amt").alias("amt"),
        text("gender").alias("gender"),
        fn.haversine_km(*[number(c) for c in POSITIONS]).cast("float").alias("distance_achat"),
        fn.age(born, as_of_year=as_of_year).cast("bigint").alias("age"),
        number("city_pop", "bigint").alias("city_pop"),
        *[c.cast("float").alias(name) for name, c in fn.cyclic_columns(paid).items()],
    )
