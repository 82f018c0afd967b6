"""Record layouts of the transaction fact and its companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXT, WHOLE, LONG, DAY, TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType()
AMOUNT, DEGREES = T.DecimalType(10, 2), T.DecimalType(10, 6)


def struct_of(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Column names, types and order of the public record layouts.
RAW_FIELDS = [
    ("trans_date_trans_time", TIME),
    ("cc_num", LONG),
    ("merchant", TEXT),
    ("category", TEXT),
    ("amt", AMOUNT),
    ("first", TEXT),
    ("last", TEXT),
    ("gender", TEXT),
    ("street", TEXT),
    ("city", TEXT),
    ("state", TEXT),
    ("zip", WHOLE),
    ("lat", DEGREES),
    ("long", DEGREES),
    ("city_pop", WHOLE),
    ("job", TEXT),
    ("dob", DAY),
    ("trans_num", TEXT),
    ("unix_time", LONG),
    ("merch_lat", DEGREES),
    ("merch_long", DEGREES),
    ("is_fraud", WHOLE),
]
SCORE_FIELDS = [
    ("prediction", WHOLE),
    ("prediction_proba", T.DecimalType(5, 4)),
    ("model_version", TEXT),
    ("fast_pass_suspicion", WHOLE),
    ("fast_pass_score", WHOLE),
    ("prediction_latency_ms", T.DecimalType(10, 4)),
    ("shap_values", TEXT),
    ("logged_at", TIME),
]
# The columns a raw text file must be coerced in.
NUMERIC_TEXT_COLUMNS = ["amt", "lat", "long", "city_pop", "unix_time", "merch_lat", "merch_long", "is_fraud"]
# Columns added to an older fact start at zero.
ADDED_COLUMN_DEFAULTS = {
    "fast_pass_suspicion": 0,
    "fast_pass_score": 0,
    "prediction_latency_ms": 0,
}


RAW_TRANSACTION = struct_of(RAW_FIELDS)
RAW_TEXT = struct_of([(name, TEXT) for name, _ in RAW_FIELDS])
SCORED_TRANSACTION = struct_of(RAW_FIELDS + SCORE_FIELDS)
RULES = struct_of(
    [
        ("thresholds", T.MapType(TEXT, T.DoubleType())),
        ("suspicious_categories", T.ArrayType(TEXT)),
        ("suspicious_hours", T.ArrayType(WHOLE)),
        ("suspicious_weekdays", T.ArrayType(WHOLE)),
        ("suspicious_months", T.ArrayType(WHOLE)),
    ]
)


def align_schema(
    df: DataFrame,
    schema: T.StructType = SCORED_TRANSACTION,
    defaults: dict[str, object] = ADDED_COLUMN_DEFAULTS,
) -> DataFrame:
    """Bring older rows to the current layout: add what is missing, fill defaults."""
    present = set(df.columns)

    def field(f: T.StructField) -> Column:
        column = F.col(f.name) if f.name in present else F.lit(None)
        column = column.cast(f.dataType)
        if f.name in defaults:
            column = F.coalesce(column, F.lit(defaults[f.name]).cast(f.dataType))
        return column.alias(f.name)

    return df.select(*[field(f) for f in schema.fields])


def union_evolving(old: DataFrame, new: DataFrame, defaults: dict[str, object] = ADDED_COLUMN_DEFAULTS) -> DataFrame:
    """Bag union of two layouts of the same table, missing columns filled."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select(
        *[
            F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name)
            if f.name in defaults
            else F.col(f.name)
            for f in both.schema.fields
        ]
    )
