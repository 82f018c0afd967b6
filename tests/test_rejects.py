"""Accepted and rejected rows are all rows, whatever they come from."""

import json

from pyspark.sql import functions as F

from cardwatch.schema import RAW_TRANSACTION
from cardwatch.session import scratch_path
from cardwatch.sources import rejects, sinks


def test_csv_lines(spark, fact):
    raw = fact.select(*RAW_TRANSACTION.names).limit(40)
    path, checked = scratch_path(spark, "csv"), scratch_path(spark, "checked")
    sinks.write_csv(raw, path)
    header = ",".join(RAW_TRANSACTION.names)
    spark.createDataFrame([(header,), ("only,two",), ("x" * 10,)], "value string").coalesce(1).write.mode("append").text(path)
    rejects.write_checked(rejects.read_csv_with_lines(spark, path), checked)
    good, bad = rejects.accepted(spark, checked), rejects.rejected(spark, checked).collect()
    assert good.count() == 40 and good.exceptAll(raw.select(*good.columns)).isEmpty()
    assert sorted(row[rejects.LINE] for row in bad) == ["only,two", "x" * 10]
    assert all("malformed line" in row[rejects.REASON] and row[rejects.FILE].endswith(".txt") for row in bad)
    assert good.count() + len(bad) == spark.read.text(path).filter(F.col("value") != header).count()


def test_payments_without_a_time_are_there(spark, fact):
    raw = fact.select(*RAW_TRANSACTION.names).limit(50)
    holes = raw.withColumn("trans_date_trans_time", F.when(F.col("unix_time") % 3 > 0, F.col("trans_date_trans_time"))).withColumn("origin", F.lit("queue"))
    checked = scratch_path(spark, "checked")
    rejects.write_checked(holes, checked)
    bad = rejects.rejected(spark, checked).collect()
    assert bad and len(bad) == holes.filter("trans_date_trans_time IS NULL").count() == 50 - rejects.accepted(spark, checked).count()
    assert all(row[rejects.REASON] == "trans_date_trans_time missing" and row.origin == "queue" and json.loads(row.source_fields)["trans_num"] for row in bad)
