"""Finished runs and the champion among them, kept in a folder every executor can reach.

`runs` holds one row per run and `models` the fitted pipelines.  The champion is named by the newest of the numbered
records in `champions`: a record is written beside them and moved into place, and the move fails if the number is
taken, so that of two promotions at once one is refused and no reader ever sees half a record.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.operators.metrics import champion_run
from cardwatch.plans.training import Model
from cardwatch.sources.files import place_new, read_newest

RUNS = "run_id string, experiment string, run_name string, start_time timestamp_ntz, metrics map<string,double>, params map<string,double>, model_path string"
FIGURE = "f2_class_1"


class Refused(RuntimeError):
    """Another promotion took place since the champion was read."""


class Registry:
    """Runs, models and the champion below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def record(self, experiment: str, run_name: str, model: Model, metrics: dict[str, float], params: dict[str, float], started: datetime) -> str:
        """Stores the model, then the row that names it; the id of the new run."""
        run_id = uuid.uuid4().hex
        path = f"{self.folder}/models/{run_id}"
        model.save(self.spark, path)
        row = (run_id, experiment, run_name, started, {k: float(v) for k, v in metrics.items()}, {k: float(v) for k, v in params.items()}, path)
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return run_id

    def runs(self) -> DataFrame:
        """All runs, with `champion` true for the one of the newest record; no rows before the first run."""
        try:
            stored = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")
        except PySparkException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], RUNS)
        return stored.withColumn("champion", F.col("run_id").eqNullSafe(F.lit((self.newest() or {}).get("run_id"))) & F.col("run_id").isNotNull())

    def newest(self) -> dict | None:
        """The newest champion record: number, run_id, figure; None before the first promotion."""
        return read_newest(self.spark, f"{self.folder}/champions")

    def promote(self, run_id: str, figure: float, seen: dict | None) -> None:
        """Makes a run the champion, given the champion record `seen` when that was decided."""
        number = seen["number"] + 1 if seen else 1
        if not place_new(self.spark, f"{self.folder}/champions", number, {"number": number, "run_id": run_id, "figure": figure}):
            raise Refused(f"champion {number} was named meanwhile")

    def challenge(self, run_id: str, figure: float) -> bool:
        """Promotes the run if there is no champion or its figure is higher; whether it was promoted."""
        while True:
            seen = self.newest()
            if seen and seen["figure"] >= figure:
                return False
            try:
                self.promote(run_id, figure, seen)
                return True
            except Refused:
                continue  # compare with the new champion

    def champion(self) -> DataFrame:
        """The champion's run, else the newest run; no row before the first."""
        return champion_run(self.runs())

    def champion_model(self) -> tuple[Model, int] | None:
        """(the champion's model, its number) or None; the number is the version of what it scores."""
        seen = self.newest()
        if seen is None:
            return None
        return self.model(seen["run_id"]), seen["number"]

    def model(self, run_id: str) -> Model:
        """The stored model of a run."""
        return Model.load(self.spark, self.runs().filter(F.col("run_id") == run_id).first()["model_path"])
