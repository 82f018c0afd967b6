"""The queue of time-sliced files: filling it, draining it, scoring each batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cardwatch import functions as fn
from cardwatch.operators import features as ft
from cardwatch.operators.alerts import alert_payloads
from cardwatch.operators.filters import TS
from cardwatch.operators.history import DAY
from cardwatch.operators.rules import fast_pass
from cardwatch.plans.explain import Weight, attribute
from cardwatch.plans.champions import Registry
from cardwatch.plans.training import score
from cardwatch.plans.warehouse import stg_transactions
from cardwatch.schema import RAW_FIELDS, RAW_TEXT, SCORED_TRANSACTION
from cardwatch.sources.files import TIMESTAMP_TEXT, place_new, read_newest, typed
from cardwatch.sources.key_index import KeyIndex
from cardwatch.sources.levels import LevelledTable
from cardwatch.sources.sinks import append_if_absent, file_ledger, insert_if_absent


def slice_bins(df: DataFrame, start: Column, span_micros: int, bins: int = 30, ts: str = TS) -> DataFrame:
    """Cut [start, start + span) into equal bins; add the bin number and its file name.

    Empty bins simply have no rows.  Rows outside the span are left for another run.
    """
    since = fn.epoch_micros(F.col(ts)) - fn.epoch_micros(start)
    number = F.floor(since * bins / F.lit(span_micros)).cast("int")
    opening = F.timestamp_add("MICROSECOND", (number * F.lit(span_micros) / bins).cast("bigint"), start)
    inside = df.filter((since >= 0) & (since < span_micros))
    return inside.withColumn("bin_number", number + 1).withColumn(
        "file_name", fn.bin_file_name(F.col("bin_number"), opening)
    )


def whole_days(df: DataFrame, ts: str = TS) -> tuple[Column, int]:
    """(start, microseconds) of the whole days from the first to the last row, as `slice_bins` takes them.

    One row reaches the driver.  Without any time it is one day, so that an empty table has no rows to cut.
    """
    first, last = df.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
    first, last = first or date(1970, 1, 1), last or date(1970, 1, 1)
    return F.lit(first).cast("timestamp_ntz"), ((last - first).days + 1) * DAY


def start_of_slices(source: DataFrame, target: DataFrame, ts: str = TS) -> Column:
    """Resume at the newest row of the target, else 30 days into the source."""
    resume = target.agg(F.max(ts).alias("t")).scalar()
    return F.coalesce(resume, source.agg((F.min(ts) + F.expr("INTERVAL 30 DAYS")).alias("t")).scalar())


def write_queue(sliced: DataFrame, folder: str) -> None:
    """One sub-folder of headed CSV per bin; a bin is spread over as many files as tasks hold it."""
    columns = [name for name, _ in RAW_FIELDS]
    sliced.select(*columns, "file_name").write.mode("append").partitionBy("file_name").option("timestampNTZFormat", TIMESTAMP_TEXT).csv(folder, header=True)


def queue_stream(
    spark: SparkSession, folder: str, schema: StructType = RAW_TEXT, files_per_batch: int = 1, **options: str
) -> DataFrame:
    """Headed CSV files as they arrive, `files_per_batch` at a time, as text plus the name
    of their slice (or, for a file on its own, of the file).

    An empty folder gives no batch.  On a cluster raise `files_per_batch` (or set
    `maxBytesPerTrigger`) so that one batch keeps every executor busy.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("header", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    slice_name = F.regexp_extract(F.col("_metadata.file_path"), r"/file_name=([^/]+)/", 1)
    return reader.csv(folder).withColumn("file_name", F.coalesce(F.nullif(slice_name, F.lit("")), F.col("_metadata.file_name")))


DAILY_SUMS = {"total_transactions": "bigint", "total_volume": "decimal(20,2)", "fraud_transactions_count": "bigint"}
DAILY_SHARE = "transaction_date date, merchant_name string, " + ", ".join(f"{name} {kind}" for name, kind in DAILY_SUMS.items())
ALERT = "trans_num string, alert_ts timestamp_ntz, payload string"

Scorer = Callable[[DataFrame], DataFrame]


def unscored(df: DataFrame) -> DataFrame:
    """Scorer for when no model is ready: nothing is predicted, the rules still run."""
    return df.withColumns(
        {
            "prediction": F.lit(0),
            "prediction_proba": F.lit(0).cast("decimal(5,4)"),
            "model_version": F.lit("none"),
        }
    )


def pinned_scorer(registry: Registry, checkpoint: str) -> Scorer:
    """Scores with the champion of the moment at which a stream first asked; later champions do not change a running queue.

    The run is named in a record under the stream's checkpoint, so a restarted stream loads the same model, once per
    start.  Without a champion nothing is pinned and nothing is predicted.
    """
    spark, folder = registry.spark, f"{checkpoint}/model"
    pinned = read_newest(spark, folder)
    champion = registry.newest()
    if pinned is None and champion is not None:
        place_new(spark, folder, 1, champion)
        pinned = read_newest(spark, folder)  # of two starts at once the first one's
    if pinned is None:
        return unscored
    model = registry.model(pinned["run_id"])
    return lambda rows: score(rows, model, pinned["number"])


def prepare_batch(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Typed rows with features and the rule score."""
    return fast_pass(ft.engineered(typed(raw)), rules)


# columns of a scored batch that its outputs read
WRITTEN = {*SCORED_TRANSACTION.names, "file_name", "unix_time"}


def score_batch(
    raw: DataFrame, batch_id: int, target: str, outbox: str, ledger: str, rules: DataFrame,
    scorer: Scorer = unscored, weights: dict[str, Weight] | None = None,
) -> None:
    """Score one micro-batch and write fact, alerts and ledger.

    Each output has a folder per batch that a retry overwrites, so a batch that fails
    half-way and runs again leaves no duplicates; an error fails the batch, so no file
    counts as done before its rows are stored.
    """
    started = time.perf_counter()
    scored = attribute(scorer(prepare_batch(raw, rules)), weights or {})
    # the cache holds what is written, its file and its order: not the features, which no output has
    scored = scored.select(*[c for c in scored.columns if c in WRITTEN]).persist()
    rows = scored.count()
    elapsed_ms = (time.perf_counter() - started) * 1000.0
    if rows:
        stamped = scored.withColumn("prediction_latency_ms", F.lit(elapsed_ms / rows).cast("decimal(10,4)"))
        # files are listed by time, the queue is ordered by name: the name decides who came first
        written = append_if_absent(stamped, target, batch_id, arrival=[F.col("file_name"), F.col("unix_time")])
        alert_payloads(written).write.mode("overwrite").parquet(f"{outbox}/batch_id={batch_id}")
        file_ledger(scored).write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")
    scored.unpersist()


def run_queue(
    spark: SparkSession, folder: str, target: str, checkpoint: str, outbox: str, ledger: str, rules: DataFrame,
    scorer: Scorer = unscored, weights: dict[str, Weight] | None = None, files_per_batch: int = 1, **options: str,
) -> StreamingQuery:
    """Drain the queue and stop.  The checkpoint knows which files are done.

    Pass `cleanSource="delete"` (or archive) to have finished files removed; that is
    best effort, so an empty folder is not the end-of-queue signal.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, target, outbox, ledger, rules, scorer, weights)

    return (
        queue_stream(spark, folder, files_per_batch=files_per_batch, **options)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merchant_days(scored: DataFrame) -> DataFrame:
    """Counts and volume per merchant and day; those of several parts add up."""
    return (
        stg_transactions(scored)
        .groupBy(fn.txn_day(F.col("transaction_timestamp")).alias("transaction_date"), "merchant_name")
        .agg(
            F.count("transaction_id").alias("total_transactions"),
            F.sum("transaction_amount").alias("total_volume"),
            F.count(F.when(F.col("is_predicted_fraud") == 1, 1)).alias("fraud_transactions_count"),
        )
    )


def _sums(shares: DataFrame) -> DataFrame:
    return shares.groupBy("transaction_date", "merchant_name").agg(*[F.sum(name).cast(kind).alias(name) for name, kind in DAILY_SUMS.items()])


def _daily_table(spark: SparkSession, path: str) -> LevelledTable:
    return LevelledTable(spark, path, DAILY_SHARE, _sums)


def live_daily_metrics(scored_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The merchant-day mart as a stream: each micro-batch commits its share, once; shares of several batches are summed
    level by level, so the folders to read grow with the logarithm of the batches.

    No row is too late and no day has to close: `read_daily_metrics` adds up the shares.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        _daily_table(batch.sparkSession, path).add(batch_id, merchant_days(batch))

    return _into_batches(scored_stream, handle, checkpoint)


def read_daily_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The mart as of the batches that are done; equals that of all their rows together."""
    return _daily_table(spark, path).read()


def _alert_table(spark: SparkSession, path: str) -> LevelledTable:
    return LevelledTable(spark, path, ALERT)


def live_alerts(scored_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alert payloads as they happen, each transaction once, however late: a batch is compared with the stored keys
    in the buckets that its own keys fall in.  One stream writes the table.

    The rows are committed, then their keys.  A batch that failed in between commits its keys when it is run
    again; one that is whole changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index, table = KeyIndex(spark, f"{path}/_keys", "trans_num"), _alert_table(spark, path)
        if index.holds_batch(batch_id):
            return
        payloads, seen = alert_payloads(batch).persist(), index.manifest()
        keys = payloads.select("trans_num").distinct()
        table.add(batch_id, insert_if_absent(payloads, index.known(keys, seen), arrival=[F.col("alert_ts"), F.col("payload")]))
        index.commit(batch_id, keys, seen)
        payloads.unpersist()

    return _into_batches(scored_stream, handle, checkpoint)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts written by `live_alerts`; empty when nothing was written yet."""
    return _alert_table(spark, path).read()


def _into_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
