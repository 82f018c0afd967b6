"""Reading transactions, rules and reports from files and tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.types import StructType

from cardwatch.schema import NUMERIC_TEXT_COLUMNS, RAW_TEXT, RAW_TRANSACTION, RULES


# How times are written in text files, fraction optional.
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def numbered_texts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the records that `place_new` put in a folder, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = (status.getPath().getName() for status in files.listStatus(path))
    return sorted(name for name in names if name.endswith(".json"))


def read_newest(spark: SparkSession, folder: str) -> dict | None:
    """The record of the highest number, None before the first."""
    names = numbered_texts(spark, folder)
    return json.loads(spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()["value"]) if names else None


def place_new(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Puts a record under a number, whole or not at all; False if the number is taken.

    The record is written beside its place and moved there, and the move does not overwrite.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    beside, target = fs.Path(f"{folder}/_{uuid.uuid4().hex}"), fs.Path(f"{folder}/{number:012d}.json")
    files = beside.getFileSystem(conf)
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    beside, target = files.makeQualified(beside), files.makeQualified(target)
    try:
        fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, target, no_options)
    except Py4JJavaError as error:
        files.delete(beside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_transactions(spark: SparkSession, path: str, schema: StructType = RAW_TRANSACTION) -> DataFrame:
    """Typed scan of headed CSV files; unreadable fields become NULL."""
    reader = spark.read.schema(schema).options(header="true", mode="PERMISSIVE", timestampNTZFormat=TIMESTAMP_TEXT)
    return reader.csv(path)


def read_raw_strings(spark: SparkSession, path: str) -> DataFrame:
    """Scan as text, so a 19-digit card number keeps every digit, then coerce the
    numeric columns; what is not a number becomes NULL."""
    return coerce_numbers(spark.read.schema(RAW_TEXT).csv(path, header=True))


def coerce_numbers(text: DataFrame) -> DataFrame:
    return text.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC_TEXT_COLUMNS})


def typed(text: DataFrame) -> DataFrame:
    """Text or loosely typed rows in the layout of the raw transaction, other columns kept."""
    extra = [c for c in text.columns if c not in RAW_TRANSACTION.names]
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RAW_TRANSACTION.fields], *extra)


# bytes of rows that a task of `write_day_table` sorts in memory
TASK_BYTES = 256 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes that a sort holds for a row: 8 a field and for the row, and what its texts and nested values need."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType)
    texts = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    lengths = [F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 4 for name in texts]
    return sum(lengths, F.lit(8 * (len(df.columns) + 4)).cast("bigint"))


def write_day_table(df: DataFrame, name: str, path: str, ts: str = "trans_date_trans_time", rows_per_file: int = 5_000_000) -> None:
    """Stores rows as an external table laid out by `event_day`, so that a filter on it reads those days alone.

    Rows are placed by day and time, so a day with very many rows lies in several files, each of a part of the day.  A
    file has at most about `rows_per_file` rows and TASK_BYTES as they are sorted, so a task's memory does not grow with
    the table.  Rows of one time, or without one, are spread by a hash; those without are in the null day.  The table must not exist.
    """
    dated = df.withColumn("event_day", F.to_date(ts))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    files = max(1, -(-rows // rows_per_file), -(-(size or 0) // TASK_BYTES))
    spread = F.xxhash64(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    placed = dated.repartitionByRange(files, "event_day", ts, spread).sortWithinPartitions("event_day", ts)
    placed.write.partitionBy("event_day").option("path", path).saveAsTable(name)


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.table(name)
    return table.select(*columns) if columns else table


def read_with_fallback(spark: SparkSession, table: str, csv_path: str) -> DataFrame:
    """The table when it exists and holds rows, else the CSV files."""
    if spark.catalog.tableExists(table):
        stored = spark.table(table)
        if not stored.isEmpty():
            return stored
    return read_transactions(spark, csv_path)


def feature_source(scored: DataFrame) -> DataFrame:
    """What the card feature view stores, with its event time."""
    return scored.select("cc_num", "gender", "dob", "city_pop", "logged_at")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule document: no row when the folder or file does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RULES)
    return parse_rules(spark.read.text(path, wholetext=True), "value")


def parse_rules(documents: DataFrame, column: str) -> DataFrame:
    """Readable documents only: one that is no JSON, or has none of the fields, is no document."""
    parsed = documents.select(F.from_json(F.col(column), RULES).alias("rules")).select("rules.*")
    return parsed.dropna("all")


REPORT = "map<string, map<string, string>>"
DRIFT_REPORT = (
    "current_date string, sample_size bigint, drift_detected boolean, mean_drift_ratio double, "
    "details map<string, struct<drift_detected:boolean, metric_value:double, threshold:double, method:string>>"
)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric files, `{run: {metric: number}}`, as (run_name, metric, value) rows."""
    return flatten_metrics(spark.read.text(path, wholetext=True), F.col("value"))


def flatten_metrics(documents: DataFrame, document: Column) -> DataFrame:
    runs = documents.select(F.explode(F.from_json(document, REPORT)).alias("run_name", "metrics"))
    pairs = runs.select("run_name", F.explode("metrics").alias("metric", "text"))
    return pairs.select("run_name", "metric", F.col("text").try_cast("double").alias("value")).filter("value is not null")


def read_drift_report(spark: SparkSession, path: str) -> DataFrame:
    """A stored drift report as one row per column."""
    return flatten_drift(spark.read.text(path, wholetext=True), F.col("value"))


def flatten_drift(documents: DataFrame, document: Column) -> DataFrame:
    report = documents.select(F.from_json(document, DRIFT_REPORT).alias("r"))
    head = ["current_date", "sample_size", "mean_drift_ratio"]
    return report.select(
        *[F.col(f"r.{c}").alias(c) for c in head], F.explode("r.details").alias("column_name", "d")
    ).select(*head, "column_name", "d.*")
