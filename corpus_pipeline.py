"""A corpus made fit for training: quality, rules, exact and near copies, packing.

Every stage reads what the one before it has kept, as Parquet.  All but the last return the
columns of `documents`.  Each stage sets the session's Arrow batches to BATCH_BYTES, as the workers of
one stage go on to the next and keep the memory they have once taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.llm import classifier, dedup, jaccard, queries, rules
from cardwatch.llm.common import table
from cardwatch.session import durable


BATCH_BYTES = 4 << 20


def _small_batches(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


def _as_labelled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts to learn from: the raw documents, so that a stage learns the same whatever the one before dropped."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold."""
    model = classifier.fit_classifier(_as_labelled(spark, docs, sf_dir), queries.training_labels(spark, sf_dir))
    scored = classifier.with_scores(docs, model, score="_score")
    return scored.filter(F.col("_score") >= queries.THRESHOLD).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    model = rules.fit_rules(_as_labelled(spark, docs, sf_dir), queries.training_labels(spark, sf_dir))
    judged = rules.with_rule_columns(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return judged.filter("kept").select("_row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows (doc, text, row): all columns of `docs`, and a number that no other row has.

    That is the id where ids can tell rows apart.  With null or repeated ids a stored copy is
    numbered in the order of the ids, null ids last.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("row"))
    if not rows.groupBy("row").count().filter("row IS NULL OR count > 1").isEmpty():
        placed = rows.withColumn("at", F.monotonically_increasing_id()).orderBy(F.col("row").asc_nulls_last(), "at")
        rows = durable(placed.select("doc", F.monotonically_increasing_id().alias("row")), "numbered")
    return rows.select("doc", "row", F.col("doc.text").alias("text"))


def _without(rows: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    return rows.join(durable(gone.select(F.col("doc_id").alias("row")), label), "row", "left_anti").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest id, null ids last, also where ids repeat."""
    rows = _numbered(docs)
    return _without(rows, dedup.exact_duplicates(rows, key="row").filter(~F.col("kept")), "copies")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last, also where ids repeat."""
    rows = _numbered(docs)
    return _without(rows, jaccard.near_duplicates(rows, key="row").filter("doc_id <> component_id"), "near-copies")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences."""
    return queries.packed_documents(docs)


STAGES = [
    ("quality classifier", _small_batches(quality_classifier)),
    ("quality rules", _small_batches(quality_rules)),
    ("exact dedup", _small_batches(exact_copies)),
    ("n-gram Jaccard join", _small_batches(near_copies)),
    ("best-fit packing", _small_batches(packing)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
