"""The file queue: one batch per file, no duplicates, rerun finds nothing."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.history import DAY
from cardwatch.sources import fixture, sinks
from cardwatch.streaming import queue


@pytest.fixture
def places(tmp_path):
    return {n: str(tmp_path / n) for n in ("files", "fact", "checkpoint", "outbox", "ledger")}


def drain(spark, places, **options):
    job = queue.run_queue(
        spark, places["files"], places["fact"], places["checkpoint"], places["outbox"], places["ledger"], fixture.fixture_rules(spark), **options
    )
    job.awaitTermination()
    return [p for p in job.recentProgress if p["numInputRows"] > 0]


def write_files(spark, sf_dir, folder, bins=3):
    raw = fixture.raw_transactions(spark, sf_dir)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    queue.write_queue(queue.slice_bins(raw, start, 30 * DAY, bins).coalesce(1), folder)
    return raw


def test_drain_rerun_and_duplicates(spark, sf_dir, places):
    raw = write_files(spark, sf_dir, places["files"])
    assert len(drain(spark, places)) == 3
    stored = sinks.read_scored(spark, places["fact"])
    assert stored.count() == raw.count() == stored.select("trans_num").distinct().count()
    assert drain(spark, places) == []
    write_files(spark, sf_dir, places["files"], bins=2)
    assert len(drain(spark, places)) == 2
    again = sinks.read_scored(spark, places["fact"])
    assert again.count() == raw.count()
    ledger = spark.read.parquet(places["ledger"])
    assert ledger.agg(F.sum("n_rows")).first()[0] == 2 * raw.count()
    assert ledger.select("file_name").distinct().count() == 5 - 1  # the first slice has the same name in both cuts


def test_batch_equals_stream(spark, sf_dir, places):
    write_files(spark, sf_dir, places["files"])
    drain(spark, places, files_per_batch=2)
    streamed = sinks.read_scored(spark, places["fact"]).select("trans_num", "fast_pass_score", "fast_pass_suspicion")
    batch = fixture.transactions(spark, sf_dir).select("trans_num", "fast_pass_score", "fast_pass_suspicion")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_empty_queue(spark, places, tmp_path):
    (tmp_path / "files").mkdir()
    assert drain(spark, places) == []
    assert sinks.read_scored(spark, places["fact"]).count() == 0


def test_retried_batch_changes_nothing(spark, fact, places):
    rows = fact.filter("event_id < 500")
    for _ in range(2):
        sinks.append_if_absent(rows, places["fact"], 4)
    assert sinks.read_scored(spark, places["fact"]).count() == rows.count()
    added = sinks.append_if_absent(fact.filter("event_id < 600"), places["fact"], 5)
    assert added.count() == 100


def test_slices_cover_the_span_once(spark, fact):
    start = F.lit("2024-01-03").cast("timestamp_ntz")
    cut = queue.slice_bins(fact, start, 5 * DAY, 7)
    inside = fact.filter("trans_date_trans_time >= '2024-01-03' AND trans_date_trans_time < '2024-01-08'")
    assert cut.count() == inside.count()
    assert cut.agg(F.min("bin_number"), F.max("bin_number")).first()[0:2] == (1, 7)
    assert fact.select(queue.start_of_slices(fact, fact.limit(0)).alias("s")).first()["s"].isoformat().startswith("2024-01-31")
