"""Lines that many documents share, found through levelled sorted runs of line hashes.

A run is a bucketed table sorted by hash: one row per line key with the number of documents
that have it.  A batch of documents leaves out, by a merge anti-join with the runs, the keys they
already hold often enough, and adds a run of its own; when a level has `FANOUT` runs they are
merged into one of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.llm.common import SPACES, whole_text
from cardwatch.session import durable, scratch_path

FANOUT = 2
KEYS_PER_BUCKET = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # lower() changes other letters too, so it is only for lines of one-byte characters
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _second_hash(key: Column) -> Column:
    return F.xxhash64(F.lit("line"), key)


class LineRuns:
    """Document counts of line keys (h1, h2), in levels of sorted runs."""

    def __init__(self, spark: SparkSession, buckets: int, enough: int) -> None:
        self.spark, self.buckets, self.enough = spark, buckets, enough
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = counts.repartition(self.buckets, "h1", "h2")
        writer = dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", scratch_path(self.spark, "line-run")).format("parquet").saveAsTable(name)
        return name

    def _tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        every = self.spark.table(names[0])
        for name in names[1:]:
            every = every.unionByName(self.spark.table(name))
        return every.groupBy("h1", "h2").agg(F.sum("documents").alias("documents"))

    def add(self, keys: DataFrame) -> None:
        """`keys`: one row (h1, h2) per line key of each document of the batch."""
        counts = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"))
        for name in self._tables():
            settled = self.spark.table(name).filter(F.col("documents") >= self.enough)
            counts = counts.join(settled, ["h1", "h2"], "left_anti")
        self._push(0, self._write(counts))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(runs))
            for run in runs:
                self.spark.sql(f"DROP TABLE {run}")
            self._push(level + 1, merged)

    def common(self) -> DataFrame:
        """Keys of at least `enough` documents; the counts of these are lower bounds."""
        return self._merged(self._tables()).filter(F.col("documents") >= self.enough)

    def close(self) -> None:
        for name in self._tables():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def drop_common_lines(
    df: DataFrame,
    least_documents: int = 10,
    least_chars: int = 1,
    text: str = "text",
    key: str = "doc_id",
    batches: int = 4,
    keys_per_bucket: int = KEYS_PER_BUCKET,
) -> DataFrame:
    """`df` with `n_lines`, `n_dropped` and `kept_text`: common lines are gone from every document.

    A text is cut at \\n; null or empty is one empty line.  A key (`line_key`) of at least `least_chars`
    code points that occurs in at least `least_documents` rows of `df` loses all its lines; a row is a
    document, also where ids repeat or are null.  Keys are told apart by two 64-bit hashes.  The three
    columns replace columns of these names; all others pass through.
    """
    spark = df.sparkSession
    lines = F.split(whole_text(text), "\n", -1)
    pair = lambda k: F.when(F.length(k) >= least_chars, F.struct(_hash(k).alias("h1"), _second_hash(k).alias("h2")))
    # a row is known by its id and its text: rows equal in both lose the same lines
    row = {"_row_id": F.col(key), "_row_h1": _hash(whole_text(text)), "_row_h2": _second_hash(whole_text(text))}
    keys = durable(df.select(*[value.alias(name) for name, value in row.items()], F.transform(F.transform(lines, line_key), pair).alias("keys")), "line-keys")
    total = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    runs = LineRuns(spark, max(1, -(-total // keys_per_bucket)), least_documents)
    try:
        for batch in range(batches):
            chosen = keys.filter(F.pmod(F.xxhash64("_row_id", "_row_h1"), F.lit(batches)) == batch)
            # sorted, so that equal keys are neighbours and each counts once a document
            ordered = chosen.select(F.sort_array(F.filter("keys", lambda k: k.isNotNull())).alias("ordered"))
            once = F.filter("ordered", lambda k, i: (i == 0) | (k != F.get("ordered", i - 1)))
            runs.add(ordered.select(F.inline(once)))
        common = durable(runs.common().select("h1", "h2"), "common-lines")
    finally:
        runs.close()
    found = keys.select(*row, F.posexplode("keys").alias("_at", "_key")).select(*row, "_at", F.col("_key.h1").alias("h1"), F.col("_key.h2").alias("h2")).join(common, ["h1", "h2"])
    drops = found.groupBy(*row).agg(F.collect_set("_at").alias("_line_drops")).withColumnsRenamed({name: f"{name}_of" for name in row})
    same = F.lit(True)
    for name in row:
        same = same & F.col(name).eqNullSafe(F.col(f"{name}_of"))
    joined = df.withColumns({**row, "_line_texts": lines}).join(drops, same, "left")
    # both sides of array_except are hashed: the work grows with the lines, not with their square
    places = F.array_except(F.sequence(F.lit(0), F.size("_line_texts") - 1), F.coalesce("_line_drops", F.array().cast("array<int>")))
    out = joined.withColumn("_line_places", places)
    kept = F.transform("_line_places", lambda i: F.get("_line_texts", i))
    out = out.withColumns({
        "kept_text": F.array_join(F.when(F.col("_line_drops").isNull(), F.col("_line_texts")).otherwise(kept), "\n"),
        "n_lines": F.size("_line_texts").cast("long"),
        "n_dropped": (F.size("_line_texts") - F.size("_line_places")).cast("long"),
    })
    return out.drop(*row, *[f"{name}_of" for name in row], "_line_texts", "_line_drops", "_line_places")
