"""The key index: only buckets hit are read, retries change nothing, merges keep every key."""

import pytest
from pyspark.sql import Window, functions as F

from cardwatch.schema import RAW_FIELDS
from cardwatch.session import durable, scratch_path
from cardwatch.sources import fixture, sinks
from cardwatch.sources.key_index import KeyIndex
from cardwatch.sources.levels import add_batch
from cardwatch.streaming import queue


def keys(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("trans_num"))


def test_batches_are_kept_as_ranges():
    ranges = []
    for batch in (5, 0, 1, 7, 6, 1, 2):
        ranges = add_batch(ranges, batch)
    assert ranges == [[0, 2], [5, 7]]


def test_known_keys_over_many_batches(spark):
    index = KeyIndex(spark, scratch_path(spark, "index"), "trans_num", buckets=16, merged=3)
    assert index.known(keys(spark, 0, 5)).count() == 0 and not index.holds_batch(0)
    for batch in range(7):
        assert index.commit(batch, keys(spark, 100 * batch, 100 * batch + 100), index.manifest())
    manifest = index.manifest()
    assert manifest["batches"] == [[0, 6]] and sorted(run["level"] for run in manifest["runs"]) == [0, 1, 1]
    found = index.known(keys(spark, 650, 750)).collect()
    assert {row.trans_num for row in found} == {f"k{i}" for i in range(650, 700)}
    assert not index.commit(9, keys(spark, 0, 1), {**manifest, "number": manifest["number"] - 1})  # decided on an old manifest
    assert not index.holds_batch(9)


def test_a_small_batch_reads_few_files(spark):
    index = KeyIndex(spark, scratch_path(spark, "index"), "trans_num", buckets=64)
    index.commit(0, keys(spark, 0, 20_000), index.manifest())
    few = durable(keys(spark, 19_998, 20_001), "few")
    buckets = few.select(index._bucket()).distinct().count()
    read = index._stored(index.manifest()["runs"], few, sorted(r[0] for r in few.select(index._bucket()).distinct().collect()))
    assert buckets <= 3 and read.select(F.input_file_name()).distinct().count() == buckets
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.known(few).count() == 2


def test_append_looks_keys_up(spark, fact):
    path = scratch_path(spark, "fact")
    rows = fact.limit(60).withColumn("n", F.row_number().over(Window.orderBy("trans_num")))
    rows = durable(rows, "rows")
    assert sinks.append_if_absent(rows.filter("n <= 40"), path, 0).count() == 40
    assert sinks.append_if_absent(rows.filter("n > 20"), path, 1).count() == 20
    # a committed batch is not written again, whatever it is given
    assert sinks.append_if_absent(rows.limit(0), path, 1).count() == 20
    assert sinks.read_scored(spark, path).count() == 60
    # a batch that was written but not committed is written anew
    sinks.align_schema(rows.withColumn("trans_num", F.concat(F.lit("lost"), "trans_num"))).write.parquet(f"{path}/batch_id=2")
    assert sinks.append_if_absent(rows.withColumn("trans_num", F.concat(F.lit("new"), "trans_num")), path, 2).count() == 60
    assert sinks.read_scored(spark, path).filter("trans_num LIKE 'lost%'").isEmpty()


def test_a_table_without_an_index_gets_one(spark, fact):
    path = scratch_path(spark, "fact")
    rows = durable(fact.limit(30), "rows")
    sinks.align_schema(rows).write.parquet(f"{path}/batch_id=0")
    assert sinks.append_if_absent(rows, path, 1).count() == 0
    assert KeyIndex(spark, f"{path}/_keys", "trans_num").manifest()["batches"] == [[0, 1]]


def test_append_moves_only_rows_of_repeated_new_keys(spark, fact, monkeypatch):
    """Rows of stored keys are dropped and rows of keys that come once are written where they are: only copies of a new key are ranked."""
    path, moved = scratch_path(spark, "fact"), []
    rows = durable(fact.limit(60).withColumn("n", F.row_number().over(Window.orderBy("trans_num"))), "rows")
    first = sinks.first_by_key
    monkeypatch.setattr(sinks, "first_by_key", lambda df, key, *order: moved.append(sorted(r["n"] for r in df.collect())) or first(df, key, *order))
    sinks.append_if_absent(rows.filter("n <= 20"), path, 0)
    copies = rows.filter("n in (5, 30, 31)").withColumn("amt", F.lit(0).cast("decimal(10,2)"))
    added = sinks.append_if_absent(rows.unionByName(copies), path, 1, arrival=[F.col("amt")])
    assert moved == [[30, 30, 31, 31]]
    assert sorted(r["trans_num"] for r in added.collect()) == sorted(r["trans_num"] for r in rows.filter("n > 20").collect())
    copied = [r["trans_num"] for r in copies.filter("n > 20").collect()]
    assert {r["amt"] for r in added.filter(F.col("trans_num").isin(copied)).collect()} == {0}


def test_a_batch_caches_what_is_written(spark, fact, monkeypatch):
    cached = []

    class Seen(Exception):
        pass

    def stop(batch, *args, **options):
        cached.extend(batch.columns)
        raise Seen

    monkeypatch.setattr(queue, "append_if_absent", stop)
    raw = fact.select(*[name for name, _ in RAW_FIELDS]).limit(5).withColumn("file_name", F.lit("f"))
    with pytest.raises(Seen):
        queue.score_batch(raw, 0, *[scratch_path(spark, name) for name in ("fact", "outbox", "ledger")], fixture.fixture_rules(spark))
    assert {"trans_num", "shap_values", "file_name", "unix_time"} <= set(cached) and not {"hour_sin", "distance_achat", "age"} & set(cached)
