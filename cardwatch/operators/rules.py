"""Threshold-rule scoring and mining of the rules from attributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch import functions as fn
from cardwatch.operators.ordered import exact_percentiles

# Default thresholds, points per rule, score that raises suspicion.
DEFAULT_THRESHOLDS = {"amt_max": 300.0, "distance_achat_max": 50.0, "age_max": 38.0, "city_pop_max": 3600.0}
POINTS = {"amt": 2, "distance_achat": 2, "category": 1, "hour": 1, "weekday": 1, "age": 1, "city_pop": 1}
SUSPICION_SCORE = 4
CONTINUOUS = ["amt", "distance_achat", "age", "city_pop"]
# A contribution spread below the first number is replaced by the second.
LOW_SPREAD, LOW_SPREAD_CUT = 0.01, 0.05
QUANTILE = 0.10


def fast_pass(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `fast_pass_score` and `fast_pass_suspicion`.

    `rules` is the rule document: one row, or none, which scores everything 0.  It
    is read as a scalar subquery, so no join takes part; more than one document is an error.
    """
    document = rules.select(F.struct("*").alias("document")).scalar()
    thresholds = document.getField("thresholds")

    def above(column: str) -> Column:
        return F.col(column).cast("double") > fn.map_get(thresholds, f"{column}_max", DEFAULT_THRESHOLDS[f"{column}_max"])

    def listed(field: str, value: Column) -> Column:
        return fn.list_contains(document.getField(field), value)

    ts = F.col("trans_date_trans_time")
    hits = {
        "amt": above("amt"),
        "distance_achat": above("distance_achat"),
        "category": listed("suspicious_categories", F.col("category")),
        "hour": listed("suspicious_hours", F.hour(ts)),
        "weekday": listed("suspicious_weekdays", F.weekday(ts)),
        "age": above("age"),
        "city_pop": above("city_pop"),
    }
    total = F.lit(0)
    for rule, hit in hits.items():
        total = total + F.when(hit, F.lit(POINTS[rule])).otherwise(F.lit(0))
    score = F.when(document.isNull(), F.lit(0)).otherwise(total)
    return df.withColumn("fast_pass_score", score).withColumn(
        "fast_pass_suspicion", F.when(F.col("fast_pass_score") >= SUSPICION_SCORE, 1).otherwise(0)
    )


def _spread(contributions: DataFrame) -> DataFrame:
    """Standard deviation and kind per feature: one row per encoded column."""
    return contributions.groupBy("feature").agg(
        F.stddev_samp("contribution").alias("spread"),
        F.every(F.col("value").isin(0.0, 1.0)).alias("is_binary"),
    )


def _significant(contributions: DataFrame, floored: bool) -> DataFrame:
    spread = _spread(contributions)
    if floored:
        cut = F.when(F.col("spread") < LOW_SPREAD, F.lit(LOW_SPREAD_CUT)).otherwise(F.col("spread"))
    else:
        cut = F.col("spread")
    # one row per model coefficient, a vector the driver already holds
    cuts = F.broadcast(spread.select("feature", "is_binary", cut.alias("cut")))
    return contributions.join(cuts, "feature").filter(F.col("contribution") > F.col("cut"))


def mine_thresholds(contributions: DataFrame) -> DataFrame:
    """Per continuous feature the 10 % quantile of the values that raise the score."""
    chosen = _significant(contributions.filter(F.col("feature").isin(CONTINUOUS)), floored=False)
    low = exact_percentiles(chosen, "value", {"low": QUANTILE}, ["feature"])
    return low.select(
        F.concat("feature", F.lit("_max")).alias("rule"), F.bround("low", 2).alias("threshold")
    )


def mine_categories(contributions: DataFrame) -> DataFrame:
    """Categories whose presence raises the score."""
    encoded = contributions.filter(F.startswith("feature", F.lit("category_")))
    chosen = _significant(encoded, floored=True)
    return (
        chosen.groupBy("feature")
        .agg(F.max(F.when(F.col("value") == 1, 1).otherwise(0)).alias("present"))
        .filter("present = 1")
        .select(fn.strip_prefix(F.col("feature"), "category_").alias("category"))
    )


CYCLES = {"hour": 24, "weekday": 7, "month": 12}


def attribution_rows(df: DataFrame, key: str, entries: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Long rows (trans_num, feature, value, contribution) from (value, contribution) per encoded column.

    The sine row of a cycle also has `cosine`, the other value, and `cycle`, both contributions together, and the cosine
    row says with `in_cycle` that it is part of one: so the two never have to be brought together again.
    """
    rows, none = [], F.lit(None).cast("double")
    for name, (value, share) in entries.items():
        part, _, wave = name.rpartition("_")
        pair = entries.get(f"{part}_cos") if wave == "sin" and part in CYCLES else None
        in_cycle = wave == "cos" and part in CYCLES and f"{part}_sin" in entries
        rows.append(
            F.struct(
                F.lit(name).alias("feature"), value.cast("double").alias("value"), share.cast("double").alias("contribution"),
                (pair[0].cast("double") if pair else none).alias("cosine"), (share + pair[1] if pair else none).alias("cycle"), F.lit(in_cycle).alias("in_cycle"),
            )
        )
    return df.select(F.col(key).alias("trans_num"), F.explode(F.array(*rows)).alias("e")).select("trans_num", "e.*")


def mine_cyclic(contributions: DataFrame) -> DataFrame:
    """Hours, weekdays and months whose summed sine and cosine contribution is high; rows are those of `attribution_rows`."""
    pairs = contributions.filter(F.col("feature").isin([f"{part}_sin" for part in CYCLES]) & F.col("cosine").isNotNull()).select(
        F.substring_index("feature", "_", 1).alias("part"), F.col("value").alias("sine"), "cosine", F.col("cycle").alias("contribution")
    )
    decoded = F.when(F.col("part") == "month", fn.decode_month(F.col("sine"), F.col("cosine")))
    for part in ("hour", "weekday"):
        decoded = decoded.when(F.col("part") == part, fn.decode_cycle(F.col("sine"), F.col("cosine"), CYCLES[part]))
    # three rows
    per_part = pairs.groupBy("part").agg(F.stddev_samp("contribution").alias("cut"))
    return (
        pairs.join(F.broadcast(per_part), "part")
        .filter(F.col("contribution") > F.col("cut"))
        .select("part", decoded.alias("position"))
        .distinct()
    )


def mine_all(contributions: DataFrame) -> DataFrame:
    """One rule per encoded column: a flag for a 0/1 column, else a threshold."""
    chosen = _significant(contributions, floored=True)
    flags = (
        chosen.filter("is_binary")
        .groupBy("feature")
        .agg(F.max(F.when(F.col("value") == 1, 1).otherwise(0)).alias("present"))
        .filter("present = 1")
        .select(F.concat(F.lit("has_"), "feature").alias("rule"), F.lit(None).cast("double").alias("threshold"))
    )
    cuts = exact_percentiles(chosen.filter("not is_binary"), "value", {"low": QUANTILE}, ["feature"])
    return flags.unionByName(
        cuts.select(F.concat("feature", F.lit("_threshold")).alias("rule"), F.bround("low", 4).alias("threshold"))
    )


def rules_document(thresholds: DataFrame, categories: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row in the layout the scorer reads.

    Months are part of the document though no rule scores them.  The lists are
    short: 4 thresholds, one entry per category, at most 24 + 7 + 12 positions.
    """
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "threshold"))))

    def positions(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("position")))).cast("array<int>")

    lists = cycles.agg(
        positions("hour").alias("suspicious_hours"),
        positions("weekday").alias("suspicious_weekdays"),
        positions("month").alias("suspicious_months"),
    )
    return lists.select(
        thresholds.agg(pairs.alias("thresholds")).scalar().alias("thresholds"),
        categories.agg(F.array_sort(F.collect_list("category")).alias("c")).scalar().alias("suspicious_categories"),
        "suspicious_hours",
        "suspicious_weekdays",
        "suspicious_months",
    )
