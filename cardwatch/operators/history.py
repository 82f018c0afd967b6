"""Per-card history: latest row, point-in-time lookup, sliding counts, card means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.functions import epoch_micros
from cardwatch.operators.hotkeys import HOT_ROWS, attach_lookup, attach_per_key, split_above, split_hot
from cardwatch.operators.ranges import RANGE_ROWS, in_ranges, with_last, with_running
from cardwatch.session import durable

HOUR = 3_600_000_000
DAY = 24 * HOUR
# Lifetime of stored card features in days.
FEATURE_TTL_DAYS = 365


def latest_by_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key; equal times go to the largest `tie`.

    `row_number = 1` is cut to one row per key inside each map task, so a key with
    very many rows costs no more to shuffle than any other.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_row", F.row_number().over(newest)).filter("_row = 1").drop("_row")


def first_by_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """First row per key in the stated order."""
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def enrich(
    requests: DataFrame,
    features: DataFrame,
    wanted: Sequence[str] = ("gender", "dob", "city_pop"),
    key: str = "cc_num",
    event_time: str = "logged_at",
    as_of: Column | None = None,
    tie: str = "trans_num",
    ttl_days: int = FEATURE_TTL_DAYS,
) -> DataFrame:
    """Request rows with the latest stored features of their card.

    Unknown cards, and cards whose newest row is older than the lifetime at `as_of`
    (default: the newest event time), get NULLs.
    """
    now = as_of if as_of is not None else features.agg(F.max(event_time).alias("now")).scalar()
    latest = latest_by_key(features, key, event_time, tie)
    alive = latest.filter(F.col(event_time) >= now - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    return attach_lookup(requests, alive, key, list(wanted))


def enrich_as_of(
    requests: DataFrame,
    features: DataFrame,
    request_id: str,
    request_time: str,
    wanted: Sequence[str] = ("gender", "dob", "city_pop"),
    key: str = "cc_num",
    event_time: str = "logged_at",
    tie: str = "trans_num",
    ttl_days: int = FEATURE_TTL_DAYS,
    hot_rows: int = HOT_ROWS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Request rows with the features known at the request time (not after it).

    Requests and feature rows are laid on one time line per card and the last
    feature row is carried forward, so no request/feature pairs are formed.  The line of a hot
    card is cut where its rows are, into ranges of about `range_rows` rows, so a burst is cut as well.
    Requests without a card get NULLs.
    """
    wanted = list(wanted)
    kinds = {f.name: f.dataType for f in features.schema.fields}
    without_card = requests.filter(F.col(key).isNull()).select(
        *[c for c in requests.columns if c not in wanted], *[F.lit(None).cast(kinds[c]).alias(c) for c in wanted]
    )
    requests, features = (df.filter(F.col(key).isNotNull()) for df in (requests, features))
    known = F.struct(F.col(event_time).alias("since"), *wanted)
    kept = [c for c in requests.columns if c not in wanted]
    timeline = features.select(
        key,
        epoch_micros(F.col(event_time)).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(tie).cast("string").alias("_tie"),
        known.alias("_known"),
        F.lit(None).cast(requests.select(F.struct(*kept).alias("s")).schema["s"].dataType).alias("_request"),
    ).unionByName(
        requests.select(
            key,
            epoch_micros(F.col(request_time)).alias("_at"),
            F.lit(1).alias("_kind"),
            F.col(request_id).cast("string").alias("_tie"),
            F.lit(None).cast(features.select(known.alias("s")).schema["s"].dataType).alias("_known"),
            F.struct(*kept).alias("_request"),
        )
    )
    order = ["_at", "_kind", "_tie"]
    hot, cold = split_hot(timeline, key, hot_rows)

    per_card = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    answered = cold.withColumn("_last", F.last("_known", ignorenulls=True).over(per_card))
    if hot is not None:
        line = in_ranges(hot, [key, *order], hot.columns, range_rows, "time-line")
        answered = answered.unionByName(with_last(line, "_known", "_last", [key]).select(*answered.columns))
    alive = F.col("_last.since") >= F.col(f"_request.{request_time}") - F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    found = answered.filter("_kind = 1").select(
        "_request.*", *[F.when(alive, F.col(f"_last.{c}")).alias(c) for c in wanted]
    )
    return found.unionByName(without_card)


# The three sliding features and how far back each looks.
VELOCITY_WINDOWS = {"count_1h": HOUR, "sum_24h": DAY, "avg_7d": 7 * DAY}


# Range frames read a whole frame for each row, so they are for cards of few rows.
FRAME_ROWS = 10_000


def velocity_features(
    df: DataFrame,
    key: str = "cc_num",
    ts: str = "trans_date_trans_time",
    amount: str = "amt",
    frame_rows: int = FRAME_ROWS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Transactions in the last hour, spend in the last 24 h and mean spend over 7 days.

    Each window holds the row itself and everything of the card back to exactly its
    length.  Range frames serve the cards of at most `frame_rows` rows.  The others are read off running
    totals at both ends of each window, over ranges of about `range_rows` marks cut where the rows are, so that
    neither a card nor an hour of it is one task.  Every row comes back once, whatever its id; a row without a
    card or a time gets NULLs.
    """
    rows = df.select(F.struct(*df.columns).alias("_kept"), F.col(key).alias("_key"), epoch_micros(F.col(ts)).alias("_at"), F.col(amount).cast("decimal(20,2)").alias("_amt"))
    placed = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    unplaced = rows.filter(~placed).select(
        "_kept.*",
        F.lit(None).cast("long").alias("count_1h"),
        F.lit(None).cast("decimal(30,2)").alias("sum_24h"),
        F.lit(None).cast("double").alias("avg_7d"),
    )
    hot, cold = split_above(rows.filter(placed), "_key", frame_rows)

    def sliding(width: int) -> Window:
        return Window.partitionBy("_key").orderBy("_at").rangeBetween(-width, 0)

    hour, day, week = (sliding(VELOCITY_WINDOWS[n]) for n in VELOCITY_WINDOWS)
    found = cold.select(
        "_kept.*",
        F.count(F.lit(1)).over(hour).alias("count_1h"),
        F.sum("_amt").over(day).alias("sum_24h"),
        (F.sum("_amt").over(week).cast("double") / F.count("_amt").over(week)).alias("avg_7d"),
    ).unionByName(unplaced)
    return found if hot is None else found.unionByName(_velocity_by_range(hot, range_rows))


def _velocity_by_range(rows: DataFrame, range_rows: int) -> DataFrame:
    """The features of rows (_kept, _key, _at, _amt) from running totals; the end of its windows carries the row."""
    # numbered when stored, so that the marks of a row keep its number if a task is run again
    numbered = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    # marks on the card's time line: 0 = start of a window, 1 = the payment, 2 = its end
    marks = F.array(
        *[
            F.struct((F.col("_at") - width).alias("at"), F.lit(0).alias("kind"), F.lit(name).alias("mark"))
            for name, width in VELOCITY_WINDOWS.items()
        ],
        F.struct(F.col("_at").alias("at"), F.lit(1).alias("kind"), F.lit("payment").alias("mark")),
        F.struct(F.col("_at").alias("at"), F.lit(2).alias("kind"), F.lit("end").alias("mark")),
    )
    line = numbered.withColumn("m", F.explode(marks)).select(
        "_key",
        "_row",
        F.col("m.at").alias("at"),
        F.col("m.kind").alias("kind"),
        F.col("m.mark").alias("mark"),
        F.when(F.col("m.kind") == 1, F.col("_amt")).alias("amt"),
        F.when(F.col("m.kind") == 2, F.col("_kept")).alias("_kept"),
    )
    payment = F.when(F.col("kind") == 1, F.lit(1)).otherwise(F.lit(0))
    sums = {"n_one": payment, "n_paid": F.when(F.col("amt").isNotNull(), F.lit(1)).otherwise(F.lit(0)), "n_amt": F.coalesce("amt", F.lit(0).cast("decimal(20,2)"))}
    placed = in_ranges(line, ["_key", "at", "kind", "_row"], ["_key", "_row", "kind", "mark", "amt", "_kept"], range_rows, "marks")
    totals = with_running(placed, sums, ["_key"]).filter("kind <> 1")

    def read(mark: str, measure: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col(f"n_{measure}")))

    def gained(mark: str, measure: str) -> Column:
        return read("end", measure) - read(mark, measure)

    per_row = totals.groupBy("_row").agg(
        F.first("_kept", ignorenulls=True).alias("_kept"),
        gained("count_1h", "one").alias("count_1h"),
        F.when(gained("sum_24h", "paid") > 0, gained("sum_24h", "amt")).cast("decimal(30,2)").alias("sum_24h"),
        (gained("avg_7d", "amt").cast("double") / F.nullif(gained("avg_7d", "paid"), F.lit(0))).alias("avg_7d"),
    )
    return per_row.select("_kept.*", *VELOCITY_WINDOWS)


def share_name(column: str, value: str, prefix: str = "nb_") -> str:
    """The name of a share of a class; dots would be read as paths."""
    return f"{prefix}{column}_is_{value.replace('.', '_')}"


def neighbour_mean(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "cc_num",
    hot_rows: int = HOT_ROWS,
    prefix: str = "nb_",
    classes: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Each row with the mean of `columns` over all rows of its card, itself included.

    This is the row-normalised same-card adjacency times the feature matrix, without
    the matrix: one aggregate per card, joined back.  `classes` names text columns with their
    values: the mean of such a column's one-hot vector is the share of each value among the card's rows.
    A missing class counts as `unknown`; a value not listed has no share.
    """
    shares = [
        F.avg((F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == value).cast("double")).alias(share_name(c, value, prefix))
        for c, values in (classes or {}).items()
        for value in values
    ]
    per_card = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_card_rows"),
        *[F.avg(F.col(c).cast("double")).alias(f"{prefix}{c}") for c in columns],
        *shares,
    )
    return attach_per_key(df, per_card, key, "_card_rows", hot_rows).drop("_card_rows")
