"""The ways taken only for hot keys and very large value sets give the plain answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import drift, history, hotkeys, ordered, rules, sampling
from cardwatch.plans import explain, training
from cardwatch.session import durable, scratch_path
from cardwatch.sources import files, fixture


def rows_of(df):
    return sorted(df.collect(), key=repr)


def skewed(fact):
    """Half of all rows on one card."""
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(F.col("cc_num"))
    return fact.withColumn("cc_num", hot.cast("bigint"))


def test_velocity_of_hot_cards(fact):
    rows = skewed(fact).select("trans_num", "cc_num", "trans_date_trans_time", "amt")
    plain = history.velocity_features(rows)
    hot = history.velocity_features(rows, frame_rows=100)
    again = history.velocity_features(rows, frame_rows=0, range_rows=500)
    show = ["trans_num", "count_1h", "sum_24h", F.round("avg_7d", 9).alias("avg_7d")]
    assert rows_of(plain.select(*show)) == rows_of(hot.select(*show)) == rows_of(again.select(*show))


def test_velocity_counts_both_window_ends(spark):
    data = [("a", 1, "2024-01-01 00:00:00", 1), ("b", 1, "2024-01-01 01:00:00", 2), ("c", 1, "2024-01-01 01:00:00.000001", 4), ("d", 1, "2024-01-01 01:00:00", 8)]
    df = spark.createDataFrame(data, "trans_num string, cc_num bigint, t string, amt int").withColumn(
        "trans_date_trans_time", F.col("t").cast("timestamp_ntz")
    )
    for limit in (1_000_000, 0):
        found = {r["trans_num"]: r["count_1h"] for r in history.velocity_features(df, frame_rows=limit).collect()}
        assert found == {"a": 1, "b": 3, "c": 3, "d": 3}


def test_as_of_lookup_of_hot_cards(fact):
    rows = skewed(fact)
    features = rows.filter("fast_pass_suspicion = 1").withColumn("logged_at", F.expr("trans_date_trans_time + INTERVAL 1 HOUR"))
    requests = rows.select("trans_num", "cc_num", F.col("trans_date_trans_time").alias("asked"))

    def answer(**options):
        return rows_of(history.enrich_as_of(requests, features, "trans_num", "asked", ("amt", "job"), ttl_days=3, **options))

    assert answer() == answer(hot_rows=100) == answer(hot_rows=0, range_rows=50)


def test_a_burst_of_one_card_is_cut(spark):
    """All payments of a card within one hour, many at one instant; the other cards keep the plain window."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 500)")
    df = spark.range(4_000).select(
        F.col("id").cast("string").alias("trans_num"),
        F.when(F.col("id") < 3_000, 1).when(F.col("id") % 50 > 0, F.col("id")).alias("cc_num"),
        at.alias("trans_date_trans_time"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 90).alias("amt"),
    )
    show = ["trans_num", "count_1h", "sum_24h", F.round("avg_7d", 9).alias("avg_7d")]
    plain = rows_of(history.velocity_features(df).select(*show))
    assert len(plain) == 4_000
    assert plain == rows_of(history.velocity_features(df, frame_rows=100, range_rows=700).select(*show))
    known = df.filter("amt % 3 = 0").withColumn("logged_at", F.col("trans_date_trans_time"))
    asked = df.select("trans_num", "cc_num", F.col("trans_date_trans_time").alias("asked"))

    def answer(**options):
        return rows_of(history.enrich_as_of(asked, known, "trans_num", "asked", ("amt",), **options))

    assert answer() == answer(hot_rows=100, range_rows=300)


def test_lookup_of_hot_cards(fact):
    rows = skewed(fact)
    requests = rows.select("trans_num", "cc_num")
    latest = history.latest_by_key(rows, "cc_num", "logged_at", "trans_num")
    plain = requests.join(latest.select("cc_num", "city_pop"), "cc_num", "left")
    assert rows_of(plain) == rows_of(hotkeys.attach_lookup(requests, latest, "cc_num", ["city_pop"], hot_rows=100))


def test_neighbour_mean_of_hot_cards(fact):
    rows = skewed(fact).select("trans_num", F.nullif("cc_num", F.lit(4000000000000003)).alias("cc_num"), "amt")
    plain = history.neighbour_mean(rows, ["amt"])
    hot = history.neighbour_mean(rows, ["amt"], hot_rows=100)
    assert plain.count() == hot.count() == rows.count()
    rounded = [c if c != "nb_amt" else F.round(c, 9).alias(c) for c in plain.columns]
    assert rows_of(plain.select(*rounded)) == rows_of(hot.select(*rounded))


def test_neighbour_shares(spark):
    rows = [(1, 7, "a.b"), (2, 7, "a.b"), (3, 7, None), (4, 8, "c"), (5, None, "c"), (6, None, "a.b")]
    df = spark.createDataFrame([(*r, "F") for r in rows], "trans_num long, cc_num long, category string, gender string")
    graph, names = training.with_neighbourhood(df, ["category", "gender"])
    assert names == ["nb_category_is_a_b", "nb_category_is_c", "nb_category_is_unknown", "nb_gender_is_F"]
    got = {r.trans_num: tuple(round(r[n], 6) for n in names) for r in graph.collect()}
    card = (0.666667, 0.0, 0.333333, 1.0)
    assert got == {1: card, 2: card, 3: card, 4: (0.0, 1.0, 0.0, 1.0), 5: (0.5, 0.5, 0.0, 1.0), 6: (0.5, 0.5, 0.0, 1.0)}
    hot = history.neighbour_mean(df, [], hot_rows=1, classes={"category": ["a.b", "c", "unknown"], "gender": ["F"]})
    assert {r.trans_num: tuple(round(r[n], 6) for n in names) for r in hot.collect()} == got


def test_a_column_of_too_many_classes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(training, "MOST_CLASSES", 3)
    df = spark.range(50).select(F.lit("F").alias("gender"), F.col("id").cast("string").alias("category"))
    with pytest.raises(ValueError):
        training.class_values(df, ["category", "gender"])


def test_running_totals_in_ranges(fact):
    fact = fact.withColumn("category", F.nullif("category", F.lit("click")))
    hist = fact.groupBy("category", F.col("amt").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    plain = ordered.running_totals(hist, "v", ["n"], ["category"])
    cut = ordered.running_totals(hist, "v", ["n"], ["category"], range_rows=17)
    assert rows_of(plain) == rows_of(cut)
    last = plain.filter("next_value is null").select((F.col("cum_n") == F.col("total_n")).alias("x")).distinct().collect()
    assert [r["x"] for r in last] == [True]


def test_percentiles_in_ranges(fact):
    shares = {"low": 0.1, "mid": 0.5, "high": 0.99}
    cut = ordered.exact_percentiles(fact, "amt", shares, ["category"], range_rows=11)
    built_in = fact.groupBy("category").agg(*[F.expr(f"percentile(cast(amt as double), {p})").alias(n) for n, p in shares.items()])
    names = ["category", *[F.round(n, 9).alias(n) for n in shares]]
    assert rows_of(cut.select(*names)) == rows_of(built_in.select(*names))


def test_sampling_is_exact_repeatable_and_disjoint(fact):
    first, again = (rows_of(sampling.sample_n(fact, 137).select("trans_num")) for _ in range(2))
    assert first == again and len(set(first)) == 137
    other = rows_of(sampling.sample_n(fact, 137, seed=7).select("trans_num"))
    assert other != first
    train, test = sampling.stratified_split(fact, 0.3)
    assert train.join(test, "trans_num").count() == 0
    assert train.count() + test.count() == fact.count()
    assert sampling.sample_n(fact, 10**9).count() == fact.count()


def test_draws_are_one_scan_without_shuffle(fact):
    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len([line for line in plan.splitlines() if "FileScan" in line and "event_mark" in line]), "Window" in plan

    source = durable(fact.select("trans_num", "is_fraud", F.lit(1).alias("event_mark")), "draw-source")
    train, test = sampling.stratified_split(source, 0.3)
    for drawn in (sampling.rebalance(source, 0.2), sampling.undersample(source), sampling.balanced_sample(source, {0: 80, 1: 20}), train, test):
        assert scans(drawn) == (1, False)


def test_draws_of_odd_rows_equal_sorted_hashes(spark):
    rows = [(None if i % 50 == 0 else i, [None, 0, 1, 2][i % 4]) for i in range(2000) if i % 50 or not i]
    df = spark.createDataFrame(rows, "trans_num long, is_fraud int")
    draws = df.select("*", F.xxhash64("trans_num", F.lit(42)).alias("h")).collect()
    for share in (0.0, 0.07, 0.5, 1.0):
        want = set()
        for value in (None, 0, 1, 2):
            own = sorted((r for r in draws if r.is_fraud == value), key=lambda r: (r.h % 2**64 >> 48, r.h))
            want |= {r.trans_num for r in own[: int(len(own) * share + 0.5)]}
        train, test = sampling.stratified_split(df, share)
        assert {r.trans_num for r in test.collect()} == want
        assert test.count() == len(want) and train.count() == len(rows) - len(want)
        assert not want & {r.trans_num for r in train.collect()}
    assert sampling.balanced_sample(df.limit(0), {0: 5, 1: 5}).count() == 0


def test_draws_of_many_classes(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("trans_num"), (F.col("id") % 300).alias("cls"))
    few = sampling.take_per_class(df, F.lit(4), "cls")
    monkeypatch.setattr(sampling, "MANY_CLASSES", 10)
    assert rows_of(few) == rows_of(sampling.take_per_class(df, F.lit(4), "cls")) and few.count() == 1200


def test_hybrid_fills_the_shortfall(fact):
    recent, reference = fact.filter("category = 'error'"), fact.filter("category <> 'error'")
    have = {r.is_fraud: r["count"] for r in recent.groupBy("is_fraud").count().collect()}
    want = {0: have[0] + 25, 1: max(1, have[1] // 2)}
    got = {(r.is_fraud, r.fresh): r["count"] for r in sampling.hybrid_sample(recent, reference, want).groupBy("is_fraud", (F.col("category") == "error").alias("fresh")).count().collect()}
    assert got == {(0, True): have[0], (0, False): 25, (1, True): want[1]}


def test_rebalance_edges(fact):
    for ratio in (0.0, 1.0, -0.5, 1.5, 0.0001):
        assert sampling.rebalance(fact, ratio).count() == fact.count()
    frauds = fact.filter("is_fraud = 1").count()
    thinned = sampling.rebalance(fact, 0.25)
    assert thinned.filter("is_fraud = 0").count() == 3 * frauds
    assert thinned.select("trans_num").distinct().count() == 4 * frauds


def test_oversample_only_repeats_frauds(fact):
    over = sampling.oversample(fact)
    normal = fact.filter("is_fraud = 0").count()
    counts = {r["is_fraud"]: r["count"] for r in over.groupBy("is_fraud").count().collect()}
    assert counts == {0: normal, 1: normal}
    assert over.filter("is_fraud = 1").join(fact.filter("is_fraud = 1"), "trans_num", "left_anti").count() == 0
    none = sampling.oversample(fact.filter("is_fraud = 0"))
    assert none.count() == normal


def test_folds_differ_by_at_most_one(fact):
    sizes = sampling.stratified_folds(fact, 5).groupBy("is_fraud", "fold").count().groupBy("is_fraud").agg(
        (F.max("count") - F.min("count")).alias("gap"), F.count(F.lit(1)).alias("folds")
    )
    assert all(r["gap"] <= 1 and r["folds"] == 5 for r in sizes.collect())


def test_wasserstein_in_ranges_equals_brute_force(spark, monkeypatch):
    import random

    draw = random.Random(3)
    ref = [draw.choice([1.0, 2.0, 3.5, 8.25]) for _ in range(40)]
    cur = [draw.uniform(0, 9) for _ in range(25)]
    data = [("reference", v) for v in ref] + [("current", v) for v in cur]
    tagged = spark.createDataFrame(data, "part string, v double")
    monkeypatch.setattr(ordered.running_totals, "__defaults__", ((), 5))
    found = drift.wasserstein(tagged, ["v"]).first()["metric_value"]
    points = sorted(set(ref + cur))
    area = sum(
        abs(sum(x <= a for x in ref) / len(ref) - sum(x <= a for x in cur) / len(cur)) * (b - a)
        for a, b in zip(points, points[1:])
    )
    mean = sum(ref) / len(ref)
    deviation = (sum((x - mean) ** 2 for x in ref) / len(ref)) ** 0.5
    assert abs(found - area / deviation) < 1e-9


def test_cycles_are_mined_without_a_shuffle_of_transactions(fact):
    rows = fixture.contributions(fact)
    for df in (rules.mine_cyclic(rows), explain.global_importance(rows), explain.local_explanation(rows, "t1")):
        assert "hashpartitioning(trans_num" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_table_by_day_is_pruned(spark, fact):
    name = "fact_by_day"
    files.write_day_table(fact, name, scratch_path(spark, name), rows_per_file=500)
    day = files.read_table(spark, name, ["trans_num", "event_day"]).filter("event_day = DATE'2024-01-05'")
    assert day.select(F.input_file_name()).distinct().count() < len(spark.table(name).inputFiles())
    assert "PartitionFilters: [isnotnull(event_day" in day._jdf.queryExecution().executedPlan().toString()
    assert files.read_with_fallback(spark, name, "/nowhere").count() == fact.count()
    spark.sql(f"DROP TABLE {name}")


def test_day_table_task_holds_few_bytes(spark, monkeypatch):
    """Wide rows are cut by their bytes, also those of one time, and none is lost."""
    name = f"wide_{uuid.uuid4().hex}"
    text = F.repeat(F.lit("x"), 1000).alias("note")
    time = F.when(F.col("id") < 300, F.lit("2024-01-05 10:00:00")).when(F.col("id") < 600, F.lit("2024-01-06 11:00:00")).cast("timestamp_ntz")
    rows = spark.range(1000).select(F.col("id"), time.alias("trans_date_trans_time"), text, F.array("id").alias("nested"))
    monkeypatch.setattr(files, "TASK_BYTES", 100_000)
    files.write_day_table(rows, name, scratch_path(spark, name))
    held = files.read_table(spark, name).groupBy(F.input_file_name().alias("file"), "event_day").agg(F.count(F.lit(1)).alias("n"))
    found = held.groupBy("event_day").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("files")).collect()
    assert sorted(r["n"] for r in found) == [300, 300, 400]
    assert all(r["files"] >= 3 and r["most"] <= 200 for r in found)
    spark.sql(f"DROP TABLE {name}")


def test_boosted_trees_leave_out_hash_places_that_do_not_occur(spark):
    """Same trees, same scores, also of values not seen in training, from a few columns instead of HASH_WIDTH."""
    rows = spark.range(400).select(
        F.concat(F.lit("t"), "id").alias("trans_num"),
        F.concat(F.lit("city"), F.col("id") % 7).alias("city"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("state"), F.col("id") % 5)).alias("state"),
        (F.col("id") * 37 % 101).cast("double").alias("amt"),
        F.when(((F.col("id") % 7).isin(2, 5)) | (F.col("id") * 37 % 101 > 80), 1).otherwise(0).alias("is_fraud"),
    )
    columns = ["amt", "city", "state"]
    model = training.train_gbt(rows, columns, trees=4, depth=4)
    learner = training.GBTClassifier(labelCol="target", weightCol=training.WEIGHT, maxIter=4, maxDepth=4, stepSize=training.RATE, seed=42, checkpointInterval=10)
    whole = training._fit(rows, columns, learner)
    assert model.pipeline.stages[-1].numFeatures <= 1 + 7 + 6 < whole.pipeline.stages[-1].numFeatures == 1 + training.HASH_WIDTH
    asked = rows.unionByName(rows.withColumns({"city": F.lit("elsewhere"), "state": F.lit(None).cast("string"), "trans_num": F.concat(F.lit("u"), "trans_num")}))
    found, wanted = (sorted(map(tuple, training.score(asked, m).select("trans_num", "prediction", "prediction_proba").collect())) for m in (model, whole))
    assert found == wanted and len({row[2] for row in found}) > 2


def test_trees_read_tasks_of_equal_size(spark, monkeypatch):
    """A small table lies in few files of any size; a level of a tree takes as long as its largest task."""
    monkeypatch.setattr(training, "ROWS_PER_TASK", 500)
    big, small = (spark.range(n, numPartitions=1).selectExpr("id", "id % 7 AS v") for n in (3_000, 40))
    uneven = big.unionByName(small)
    dealt = training._evenly(uneven)
    sizes = [row["count"] for row in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_040 and len(sizes) == training.tree_tasks(3_040, 8) == 7 and max(sizes) <= 1.5 * 3_040 / 7
    assert rows_of(dealt) == rows_of(uneven)
    even = spark.range(3_040, numPartitions=8).selectExpr("id", "id % 7 AS v")
    assert training._evenly(even) is even


def test_tasks_of_a_boosted_tree():
    assert [training.tree_tasks(rows, 12) for rows in (0, 60_000, 4_200_000, 25_200_000)] == [1, 2, 12, 36]


def test_a_fitted_boosted_tree_reads_even_tasks(spark, fact, monkeypatch):
    """The learner is given the rows in tasks of one size, whatever the files of the table."""
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    seen = []

    class Stop(Exception):
        pass

    def stop(rows):
        seen.extend(row["count"] for row in rows.groupBy(F.spark_partition_id()).count().collect())
        raise Stop

    monkeypatch.setattr(training, "Pipeline", lambda stages: type("Fit", (), {"fit": staticmethod(stop)}))
    with pytest.raises(Stop):
        training.train_gbt(training.ft.engineered(fact).coalesce(1), ["amt", "age"])
    assert len(seen) == min(8, -(-fact.count() // 100)) and max(seen) <= 1.5 * sum(seen) / len(seen)
