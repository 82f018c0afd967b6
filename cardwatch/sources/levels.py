"""Tables that grow by batches and keep few folders.

Each committed batch leaves a run, a folder of Parquet.  A manifest names the runs and the committed batches; a new
manifest is moved into place as one file, so a reader sees a batch whole or not at all and a batch that is run
again changes nothing.  Runs of one level are merged into one of the next when there are enough of them, so that
the runs to read grow with the logarithm of the batches.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardwatch.sources.files import place_new, read_newest

MERGED = 8
EMPTY = {"number": 0, "batches": [], "runs": [], "gone": []}


def add_batch(ranges: list[list[int]], batch: int) -> list[list[int]]:
    """Ranges of batch numbers with one more: consecutive numbers take one entry."""
    merged: list[list[int]] = []
    for low, high in sorted([*map(list, ranges), [batch, batch]]):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


class Levels:
    """Manifest, commits and merges; what a run holds is up to `_write` and `_stored`."""

    def __init__(self, spark: SparkSession, folder: str, merged: int = MERGED) -> None:
        self.spark, self.folder, self.merged = spark, folder.rstrip("/"), merged

    def _write(self, rows: DataFrame) -> str:
        """Stores rows as a run; its path below the folder."""
        raise NotImplementedError

    def _stored(self, runs: list[dict], like: DataFrame) -> DataFrame:
        """The rows of some runs; `like` has their types."""
        raise NotImplementedError

    def _new_path(self) -> str:
        return f"runs/{uuid.uuid4().hex}"

    def manifest(self) -> dict:
        return read_newest(self.spark, f"{self.folder}/manifest") or EMPTY

    def holds_batch(self, batch: int) -> bool:
        """Whether a batch is committed."""
        return any(low <= batch <= high for low, high in self.manifest()["batches"])

    def _commit(self, manifest: dict, **changes) -> bool:
        return place_new(self.spark, f"{self.folder}/manifest", manifest["number"] + 1, {**manifest, **changes, "number": manifest["number"] + 1})

    def commit(self, batch: int, rows: DataFrame, seen: dict) -> bool:
        """Adds the rows of a batch to the manifest `seen`; False if another writer committed meanwhile."""
        run = {"path": self._write(rows), "level": 0}
        if not self._commit(seen, batches=add_batch(seen["batches"], batch), runs=[*seen["runs"], run]):
            return False
        self.compact(rows)
        return True

    def compact(self, like: DataFrame) -> None:
        """Merges the runs of a level that has enough of them.

        Runs that a merge replaces are deleted by the next one, so that readers of the last manifest still find them.
        """
        while True:
            manifest, levels = self.manifest(), defaultdict(list)
            for run in manifest["runs"]:
                levels[run["level"]].append(run)
            full = next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.merged), None)
            if full is None:
                return
            run = {"path": self._write(self._stored(full, like)), "level": full[0]["level"] + 1}
            left = [r for r in manifest["runs"] if r not in full]
            if not self._commit(manifest, runs=[*left, run], gone=[r["path"] for r in full]):
                return  # another writer was faster, and merges in its turn
            fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            for path in manifest["gone"]:
                old = fs.Path(f"{self.folder}/{path}")
                old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


class LevelledTable(Levels):
    """Rows of one schema; `merge` turns the rows of several runs into those of one, such as sums into sums."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows, merged: int = MERGED) -> None:
        super().__init__(spark, folder, merged)
        self.schema, self.merge = schema, merge

    def _write(self, rows: DataFrame) -> str:
        path = self._new_path()
        rows.write.parquet(f"{self.folder}/{path}")
        return path

    def _paths(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{run['path']}" for run in runs])

    def _stored(self, runs: list[dict], like: DataFrame) -> DataFrame:
        return self.merge(self._paths(runs))

    def add(self, batch: int, rows: DataFrame) -> None:
        """Commits the rows of a batch, once, whoever else writes."""
        while not self.holds_batch(batch):
            if self.commit(batch, rows, self.manifest()):
                return

    def read(self) -> DataFrame:
        """All committed batches, merged; no rows before the first."""
        runs = self.manifest()["runs"]
        return self.merge(self._paths(runs)) if runs else self.spark.createDataFrame([], self.schema)
