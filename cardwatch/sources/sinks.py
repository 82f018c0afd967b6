"""Writing results: insert-if-absent, keyed update, ledger, exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cardwatch.operators.history import first_by_key
from cardwatch.schema import SCORED_TRANSACTION, align_schema
from cardwatch.sources.files import TIMESTAMP_TEXT, path_exists
from cardwatch.sources.key_index import KeyIndex


def _required(batch: DataFrame, key: str) -> Column:
    """The key; a row without one ends the job."""
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"a row to insert has no {key}")).cast(batch.schema[key].dataType))


def _order(batch: DataFrame, arrival: Sequence[Column]) -> list[Column]:
    """Who comes first of rows with one key; if nothing says so, the whole row as text, so that a second run decides alike."""
    return list(arrival) or [F.to_json(F.struct(*batch.columns))]


def insert_if_absent(
    batch: DataFrame, target: DataFrame, key: str = "trans_num", arrival: Sequence[Column] = ()
) -> DataFrame:
    """Rows of `batch` to append: new keys only, the first of each by `arrival`, else by the row's text.

    The target is first cut to the keys of the batch.  That semi join needs only the
    key column of the target and, for a batch of ordinary size, no shuffle of it.
    A row without a key is an error, as in a table with a primary key.
    """
    batch = batch.withColumn(key, _required(batch, key))
    first = first_by_key(batch, key, *_order(batch, arrival))
    known = target.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return first.join(known, key, "left_anti")


@contextmanager
def _absent(batch: DataFrame, key: str, order: Sequence[Column], index: KeyIndex, seen: dict) -> Iterator[DataFrame]:
    """The rows of `batch` to append: those of keys that are not in the index, the first of each.

    Only the keys are shuffled, and the rows of new keys that come more than once; any other row is written by the task
    that holds it.  The keys are held in the cache until the rows are written.
    """
    keys = batch.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_often")).persist()
    stored = index.known(keys.select(key), seen).withColumn("_stored", F.lit(True))
    often = keys.filter("_often").select(key, F.lit(False).alias("_stored"))
    apart = stored.unionByName(often).groupBy(key).agg(F.max("_stored").alias("_stored")).persist()
    try:
        numbers = {row["_stored"]: row["count"] for row in apart.groupBy("_stored").count().collect()}
        rows = batch.join(apart.select(key), key, "left_anti") if numbers else batch
        if numbers.get(False):
            again = batch.join(apart.filter(~F.col("_stored")).select(key), key, "left_semi")
            rows = rows.unionByName(first_by_key(again, key, *order))
        yield rows
    finally:
        apart.unpersist()
        keys.unpersist()


def append_if_absent(
    batch: DataFrame,
    path: str,
    batch_id: int,
    key: str = "trans_num",
    arrival: Sequence[Column] = (),
    logged_at: Column | None = None,
) -> DataFrame:
    """Append the new rows of a batch under `path/batch_id=N`; returns what was written.

    Keys already stored are looked up in the index below `path/_keys`, in the buckets that the batch's keys fall in; a
    table that has no index yet is read once for its keys.  The rows are written, then the index is committed: a batch
    that failed in between replaces its own folder when it is run again, and one that is committed changes nothing.
    """
    spark = batch.sparkSession
    index, folder = KeyIndex(spark, f"{path}/_keys", key), f"{path}/batch_id={batch_id}"
    stored = spark.read.schema(SCORED_TRANSACTION)
    if index.manifest()["number"] == 0 and path_exists(spark, path):
        earlier = read_scored(spark, path).filter(F.col("batch_id") != batch_id)
        for number in sorted(row[0] for row in earlier.select("batch_id").distinct().collect()):
            index.commit(number, earlier.filter(F.col("batch_id") == number).select(key), index.manifest())
    stamped = batch.withColumn("logged_at", logged_at if logged_at is not None else F.current_timestamp().cast("timestamp_ntz"))
    stamped = stamped.withColumn(key, _required(stamped, key))
    order = _order(batch, arrival)
    while not index.holds_batch(batch_id):
        seen = index.manifest()
        with _absent(stamped, key, order, index, seen) as new:
            align_schema(new).write.mode("overwrite").parquet(folder)
        if index.commit(batch_id, stored.parquet(folder).select(key), seen):
            break  # else another batch was committed meanwhile: its keys are looked up too
    return stored.parquet(folder)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """The scored fact written by `append_if_absent`; empty when nothing was written yet."""
    schema = T.StructType([*SCORED_TRANSACTION.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def backfill(
    scored: DataFrame,
    new_scores: DataFrame,
    columns: Sequence[str] = ("prediction", "prediction_proba", "model_version"),
    key: str = "trans_num",
) -> DataFrame:
    """Keyed update: rows with a new score take it, all others stay as they are.

    `new_scores` holds one row per key, as scoring the fact gives it.
    Write the result to a new path; files are never updated in place.
    """
    fresh = new_scores.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = scored.join(fresh, key, "left")
    kinds = {f.name: f.dataType for f in scored.schema.fields}

    def updated(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        return F.when(F.col("_hit"), F.col(f"new_{name}").cast(kinds[name])).otherwise(F.col(name)).alias(name)

    return joined.select(*[updated(name) for name in scored.columns])


def file_ledger(rows: DataFrame, fetched_at: Column | None = None, file_name: str = "file_name") -> DataFrame:
    """One row per ingested file: when, which, how many rows."""
    when = fetched_at if fetched_at is not None else F.current_timestamp()
    return rows.groupBy(F.col(file_name).alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        when.alias("fetched_at"), "file_name", "n_rows"
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Headed CSV export; every task writes its own file."""
    df.write.mode(mode).option("timestampNTZFormat", TIMESTAMP_TEXT).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)
