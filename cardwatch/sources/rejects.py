"""Rows that cannot be used, kept with the reason and where they came from.

Accepted and rejected rows are written by one pass over the source, into two folders of one dataset: together they are all
rows that were read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cardwatch.schema import RAW_TEXT, RAW_TRANSACTION
from cardwatch.sources.files import typed

REQUIRED = ("trans_num", "trans_date_trans_time", "cc_num", "amt")
REASON, LINE, FILE, BLOCK = "reject_reason", "source_line", "source_file", "source_block"


def read_csv_with_lines(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV as text, with the file and block a row stands in, and the whole line of a row that is no row of the layout."""
    schema = T.StructType([*RAW_TEXT.fields, T.StructField(LINE, T.StringType())])
    rows = spark.read.schema(schema).options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=LINE).csv(path)
    return rows.select(*schema.names, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


def reasons(text: DataFrame, required: Sequence[str] = REQUIRED) -> Column:
    """Comma-joined reasons against a row, empty for a good one: no row of the layout, a required field that is missing,
    a field that its type cannot read."""
    faults: list[Column] = []
    if LINE in text.columns:
        faults.append(F.when(F.col(LINE).isNotNull(), F.lit("malformed line")))
    for field in RAW_TRANSACTION.fields:
        value = F.col(field.name)
        if field.name in required:
            faults.append(F.when(value.isNull(), F.lit(f"{field.name} missing")))
        if field.dataType != text.schema[field.name].dataType:
            faults.append(F.when(value.isNotNull() & value.try_cast(field.dataType).isNull(), F.lit(f"{field.name} unreadable")))
    return F.concat_ws(",", *faults)


def write_checked(text: DataFrame, path: str, required: Sequence[str] = REQUIRED) -> None:
    """Typed rows under `path/rejected=false`, all others with their fields as text and a reason under `path/rejected=true`.

    `text` has the columns of a raw transaction, of any types, and what the reader adds; a table or queue is checked like a file.
    """
    extra = [c for c in text.columns if c not in RAW_TRANSACTION.names]
    marked = text.withColumn(REASON, reasons(text, required))
    bad = F.col(REASON) != ""
    as_text = F.when(bad, F.to_json(F.struct(*[F.col(name).cast("string").alias(name) for name in RAW_TRANSACTION.names]))).alias("source_fields")
    good = [F.when(~bad, F.col(field.name).try_cast(field.dataType)).alias(field.name) for field in RAW_TRANSACTION.fields]
    marked.select(*good, as_text, REASON, *extra, bad.alias("rejected")).write.mode("error").partitionBy("rejected").parquet(path)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The typed rows that `write_checked` let through."""
    return typed(spark.read.parquet(path).filter("rejected = 'false'")).select(*RAW_TRANSACTION.names)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(reject_reason, source_fields as JSON, and what the reader added) of all other rows."""
    rows = spark.read.parquet(path).filter("rejected = 'true'")
    return rows.drop("rejected", *RAW_TRANSACTION.names)
