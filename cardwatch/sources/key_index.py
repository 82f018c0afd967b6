"""Which keys a table holds, without reading the table.

Each committed batch leaves a run of its keys: Parquet in hash buckets, sorted, with a Bloom filter a file.  A manifest
names the runs and the committed batches; a new manifest is moved into place as one file.  A batch reads the
buckets that its own keys fall in and no others.  Runs of one level are merged into one of the next when there
are enough of them, so that the runs to look through grow with the logarithm of the batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.sources.levels import MERGED, Levels

BUCKETS = 256


class KeyIndex(Levels):
    """The keys of one table; `key` is its column, of any type that can be hashed."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS, merged: int = MERGED) -> None:
        super().__init__(spark, folder, merged)
        self.key, self.buckets = key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, runs: list[dict], keys: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """The keys in some runs, of all buckets or of those given: other buckets' folders are not listed in the plan."""
        key = keys.schema[self.key].dataType.simpleString()
        parts = [self.spark.read.schema(f"`{self.key}` {key}, bucket int").parquet(f"{self.folder}/{run['path']}") for run in runs]
        stored = parts[0]
        for part in parts[1:]:
            stored = stored.unionByName(part)
        return stored if buckets is None else stored.filter(F.col("bucket").isin(buckets))

    def known(self, keys: DataFrame, manifest: dict | None = None) -> DataFrame:
        """Those of `keys` (one column, distinct) that a committed batch holds.  Runs one job over the keys: at most
        as many numbers as there are buckets reach the driver, and name the folders to read."""
        runs = (manifest or self.manifest())["runs"]
        if not runs:
            return keys.limit(0)
        hit = sorted(row[0] for row in keys.select(self._bucket()).distinct().collect())
        return keys.join(self._stored(runs, keys, hit).select(self.key), self.key, "left_semi")

    def _write(self, keys: DataFrame) -> str:
        path = self._new_path()
        placed = keys.select(self.key, self._bucket().alias("bucket"))
        placed = placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key)
        # a key is looked for by its hash bucket, then by the least and greatest key and the Bloom filter of a row group
        placed.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.folder}/{path}")
        return path
