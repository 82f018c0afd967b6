"""Shards of near equal bytes by a k-d tree over the metadata.

Each node is split along the dimension in which its rows are spread widest, at the weighted
median (or the share of leaves that goes left), until a node is one shard.  A median is found
digit by digit: rows are summed per digit, and only the digit in which the target falls is
looked at further.  Equal texts take one position in every dimension, the smallest of any of
them, and rows of one position are ordered by text, then by row: copies are neighbours wherever the
tree cuts, a hot value or a hot text can still be split, and a cut parts the copies of the text it falls in alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.common import whole_text
from cardwatch.operators.hotkeys import attach_per_key
from cardwatch.session import durable

# bits of a row's place along a dimension: value, then text, then row; read in digits from the top
_VALUE, _TEXT, _ROW = 20, 22, 21
_SHIFTS = (47, 31, 15, 0)
ROWS_PER_BLOCK = 100_000
# a text of more rows takes its position by broadcast
HOT_TEXT_ROWS = 10_000


def _bits(value: Column, bits: int) -> Column:
    return F.pmod(value, F.lit(1 << bits))


def _grid(df: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Position 0 to 2**20 - 1 of each dimension: numbers by their range, anything else by hash; null is 0."""
    numeric = [c for c in dims if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    ends = df.agg(F.lit(0), *[f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in numeric for f in (F.min, F.max)]).first()
    grid = {}
    for c in dims:
        if c in numeric:
            low, high = ends[f"min_{c}"], ends[f"max_{c}"]
            width = (high - low) if high is not None and high > low else 1.0
            place = F.floor((F.col(c).cast("double") - F.lit(low or 0.0)) / width * ((1 << _VALUE) - 2)) + 1
        else:
            place = _bits(F.xxhash64(F.col(c)), _VALUE - 1) + 1
        grid[c] = F.coalesce(place, F.lit(0)).cast("long")
    return grid


def _by_node(values: dict[int, object], default: object) -> Column:
    return reduce(lambda chain, kv: chain.when(F.col("node") == kv[0], kv[1]), values.items(), F.when(F.lit(False), F.lit(default)))


def _cuts(rows: DataFrame, dim_of: dict[int, str], share: dict[int, float], totals: dict[int, int]) -> dict[int, int]:
    """For each node the place below which rows go left: as near to its share of the bytes as rows allow."""
    place = _by_node({n: F.col(f"at_{d}") for n, d in dim_of.items()}, None)
    placed = rows.filter(F.col("node").isin(list(dim_of))).select("node", place.alias("place"), "size")
    prefix, before, cuts = dict.fromkeys(dim_of, 0), dict.fromkeys(dim_of, 0), {}
    upper = None
    for shift in _SHIFTS:
        active = {n: prefix[n] for n in dim_of if n not in cuts}
        if not active:
            break
        inside = placed.filter(F.col("node").isin(list(active)))
        if upper is not None:
            inside = inside.filter(F.shiftright("place", upper) == _by_node({n: F.lit(p).cast("long") for n, p in active.items()}, None))
        digits = inside.groupBy("node", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("node").orderBy("digit")
        target = _by_node({n: F.lit(share[n] * totals[n] - before[n]) for n in active}, None)
        running = digits.withColumn("upto", F.sum("size").over(order)).filter((F.col("upto") >= target) & (F.col("upto") - F.col("size") <= target))
        found = running.groupBy("node").agg(F.min(F.struct("digit", "upto", "size", "rows")).alias("at")).select("node", "at.*").collect()
        for row in found:
            n, low = row["node"], before[row["node"]] + row["upto"] - row["size"]
            prefix[n], before[n] = row["digit"], low
            if row["rows"] == 1 or shift == 0:
                goal = share[n] * totals[n]
                right = goal - low < low + row["size"] - goal
                cuts[n] = (row["digit"] if right else row["digit"] + 1) << shift
        for n in active.keys() - {row["node"] for row in found}:
            cuts[n] = prefix[n] << (upper or 63)
        upper = shift
    return cuts


def kd_shards(df: DataFrame, shards: int, dims: list[str], text: str = "text", key: str = "doc_id", overhead: int = 8) -> DataFrame:
    """One row per row of `df`: doc_id, size, text_crc32, shard (0 to shards - 1), slot.

    `size` is the UTF-8 bytes of the text (null: none) plus `overhead`; shards get sizes near equal: a
    split is off by less than a row.  Equal texts stay in one shard but for those in which a cut falls,
    at most about one a cut.  Null dimension values lie before all others; rows equal in
    everything are told apart by a row number.  `slot` numbers a shard's rows from 0 without gaps.
    Other columns are left out.  Once: the positions of equal texts, an aggregate and a join of narrow rows by
    text hash, hot texts by broadcast.  Per level: one aggregate for the spreads and at most four for the
    medians, over narrow rows; the driver sees one row per node.
    """
    whole = whole_text(text)
    grid = _grid(df, dims)
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + overhead).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        *[place.alias(f"pos_{c}") for c, place in grid.items()],
    )
    rows = durable(rows, "shard-rows")
    positions = [f"pos_{c}" for c in dims]
    of_text = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in positions])
    rows = attach_per_key(rows.drop(*positions), of_text, "text_hash", "copies", HOT_TEXT_ROWS)
    row_bits = _bits(F.xxhash64("doc_id", "row"), _ROW)
    rows = rows.withColumns({f"at_{c}": F.shiftleft(f"pos_{c}", _TEXT + _ROW) + F.shiftleft(_bits(F.col("text_hash"), _TEXT), _ROW) + row_bits for c in dims})
    rows = durable(rows.drop(*positions, "text_hash", "copies").withColumn("node", F.lit(0)), "shard-places")
    leaves = {0: (0, shards)}
    next_node = 1
    while wide := {n: span for n, span in leaves.items() if span[1] - span[0] > 1}:
        spreads = rows.filter(F.col("node").isin(list(wide))).groupBy("node").agg(
            F.sum("size").alias("total"), *[(F.max(f"at_{c}") - F.min(f"at_{c}")).alias(c) for c in dims]
        ).collect()
        dim_of = {r["node"]: max(dims, key=lambda c: r[c]) for r in spreads}
        share = {n: ((hi - lo) // 2) / (hi - lo) for n, (lo, hi) in wide.items()}
        cuts = _cuts(rows, dim_of, share, {r["node"]: r["total"] for r in spreads})
        step = F.col("node")
        for n, (lo, hi) in wide.items():
            left, right = next_node, next_node + 1
            next_node += 2
            del leaves[n]
            leaves[left], leaves[right] = (lo, lo + (hi - lo) // 2), (lo + (hi - lo) // 2, hi)
            if n in cuts:
                step = F.when(F.col("node") == n, F.when(F.col(f"at_{dim_of[n]}") < cuts[n], left).otherwise(right)).otherwise(step)
        rows = durable(rows.withColumn("node", step), "shard-level")
    sharded = rows.select("doc_id", "size", "text_crc32", "row", _by_node({n: F.lit(lo) for n, (lo, _) in leaves.items()}, None).alias("shard"))
    return with_slots(sharded, "shard", "row").drop("row")


def with_slots(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard; shards are numbered block by block."""
    blocks = max(1, -(-rows.count() // ROWS_PER_BLOCK))
    rows = rows.withColumn("_block", _bits_of(order, blocks))
    sizes = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(shard).orderBy("_block")) - F.col("_rows")
    starts = sizes.select(shard, "_block", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(order)) - 1
    return rows.join(starts, [shard, "_block"]).withColumn("slot", (F.col("_start") + place).cast("long")).drop("_block", "_start")


def _bits_of(order: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(blocks))
