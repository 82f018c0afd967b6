"""The queue and the live tables hold every row, whatever its day and however late it comes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardwatch.catalog import QUERIES, queries
from cardwatch.plans import warehouse
from cardwatch.sources import fixture
from cardwatch.sources.key_index import KeyIndex
from cardwatch.sources.levels import LevelledTable
from cardwatch.streaming import queue

TS = "trans_date_trans_time"


def moved(rows):
    """Half of the payments 100 days earlier, half 200 days later."""
    early = F.crc32("trans_num") % 2 == 0
    return rows.withColumn(TS, F.when(early, F.col(TS) - F.expr("INTERVAL 100 DAYS")).otherwise(F.col(TS) + F.expr("INTERVAL 200 DAYS")))


def test_queue_holds_every_day(spark, sf_dir, monkeypatch):
    raw = fixture.raw_transactions(spark, sf_dir)
    monkeypatch.setattr(fixture, "raw_transactions", lambda spark, sf_dir: moved(raw))
    assert QUERIES["queue_drain"](spark, sf_dir).count() == raw.count()
    assert QUERIES["queue_ledger"](spark, sf_dir).first()["n_rows"] == raw.count()
    alerts = QUERIES["queue_alerts"](spark, sf_dir)
    assert alerts.count() == raw.filter("amt > 150").count() > 0


def test_ledger_holds_every_day(spark, sf_dir, fact, monkeypatch):
    monkeypatch.setattr(queries, "fact", lambda spark, sf_dir: moved(fact))
    assert QUERIES["file_ledger"](spark, sf_dir).agg(F.sum("n_rows")).first()[0] == fact.count()


@pytest.mark.parametrize("times", [[], ["2024-02-29 23:59:59.999999"], ["2023-12-31 00:00:00", "2024-01-02 23:59:59.999999"]])
def test_whole_days(spark, times):
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias(TS))
    cut = queue.slice_bins(rows, *queue.whole_days(rows), 3)
    assert cut.count() == len(times) and {r.bin_number for r in cut.collect()} <= {1, 2, 3}


@pytest.fixture
def late_stream(spark, fact, tmp_path):
    """The fact in two micro-batches, the older half after the newer one."""
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    parts = [fact.filter(F.col(TS) >= middle), fact.filter(F.col(TS) < middle)]
    folder = str(tmp_path / "arriving")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_live_mart_equals_batch_mart(spark, fact, late_stream, tmp_path):
    queue.live_daily_metrics(late_stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").awaitTermination()
    live = queue.read_daily_metrics(spark, f"{tmp_path}/rows")
    batch = warehouse.mart_merchant_daily_metrics(warehouse.stg_transactions(fact)).select("transaction_date", "merchant_name", "total_transactions", "total_volume")
    part = live.select(batch.columns)
    assert part.count() == batch.count()
    assert part.exceptAll(batch).count() == 0 and batch.exceptAll(part).count() == 0
    assert live.agg(F.sum("fraud_transactions_count")).first()[0] == fact.filter("prediction = 1").count()


def test_late_alerts_come_once(spark, fact, late_stream, tmp_path):
    for run in (1, 2):  # a new checkpoint runs the same batches again
        queue.live_alerts(late_stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint-{run}").awaitTermination()
    alerts, wanted = queue.read_alerts(spark, f"{tmp_path}/rows"), fact.filter("prediction = 1")
    assert alerts.count() == wanted.count() == alerts.select("trans_num").distinct().count() > 0


def test_live_query_has_every_day(spark, sf_dir):
    live = QUERIES["live_daily_metrics"](spark, sf_dir)
    assert live.agg(F.sum("total_transactions")).first()[0] == fixture.transactions(spark, sf_dir).count()


def test_many_batches_leave_few_folders(spark, tmp_path):
    """Shares of 30 batches, some run twice: equal sums, and runs by the logarithm of the batches."""
    table = LevelledTable(spark, str(tmp_path), "k long, n long", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), merged=3)
    assert table.read().count() == 0
    for batch in range(30):
        share = spark.range(4).select((F.col("id") % (1 + batch % 4)).alias("k"), F.lit(batch).cast("long").alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
        table.add(batch, share)
        if batch % 7 == 0:
            table.add(batch, share)
    want = Counter()
    for batch in range(30):
        for k in range(4):
            want[k % (1 + batch % 4)] += batch
    assert {r.k: r.n for r in table.read().collect()} == {k: n for k, n in want.items()}
    assert len(table.manifest()["runs"]) <= 8 and table.manifest()["batches"] == [[0, 29]]
    assert len(list((tmp_path / "runs").iterdir())) <= 12


def test_alerts_whose_keys_were_not_committed(spark, fact, late_stream, tmp_path, monkeypatch):
    """A batch that ends between its rows and its keys is run again: no alert twice, none lost."""
    commit, ended = KeyIndex.commit, []

    def fails_once(self, batch, *rest):
        if not ended:
            ended.append(batch)
            raise RuntimeError("lost")
        return commit(self, batch, *rest)

    monkeypatch.setattr(KeyIndex, "commit", fails_once)
    with pytest.raises(Exception, match="lost"):
        queue.live_alerts(late_stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").awaitTermination()
    queue.live_alerts(late_stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").awaitTermination()
    alerts = queue.read_alerts(spark, f"{tmp_path}/rows")
    assert ended and alerts.count() == fact.filter("prediction = 1").count() == alerts.select("trans_num").distinct().count()
