"""The pipeline against its stages' brute-force versions on the smallest tables."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from test_dedup import brute_components, shingles
from test_tokens import placed_right


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), before.schema)
        assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = kept["quality classifier"]
    stays = {r.doc_id for r in after}
    judged = [(r.doc_id in stays) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels]
    assert sum(judged) / len(judged) > 0.95
    before, after = kept["exact dedup"]
    plain = [" ".join((r.text or "").split()) for r in after]
    assert len(set(plain)) == len(plain) and {" ".join((r.text or "").split()) for r in before} == set(plain)
    before, after = kept["n-gram Jaccard join"]
    assert {r.doc_id for r in after} == {component for (_, _, component) in brute_components(before)}
    assert all(shingles(r.text) for r in after)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    placed_right(rows, 1024)
    assert max(Counter((r.doc_id, r.piece) for r in rows).values()) == 1


def test_stages_with_odd_rows(spark, sf_dir, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge_docs, no_docs):
            out = stage(spark, docs, sf_dir)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            assert out.filter(F.lit(True)).count() >= 0


def test_copies_with_null_and_repeated_ids(spark, sf_dir):
    words = " ".join(f"w{i}" for i in range(60))
    given = [(7, words), (7, words), (None, words.replace(" ", "  ")), (None, words + " more"), (7, "other text"), (3, "b"), (3, "b"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(given)], "doc_id long, text string, row int")
    exact = corpus_pipeline.exact_copies(spark, docs, sf_dir)
    assert exact.columns == docs.columns
    left = [(r.doc_id, " ".join((r.text or "").split())) for r in exact.collect()]
    assert sorted(left, key=str) == sorted([(7, words), (None, words + " more"), (7, "other text"), (3, "b"), (9, "")], key=str)
    near = corpus_pipeline.near_copies(spark, exact, sf_dir)
    assert near.columns == docs.columns
    left = [(r.doc_id, " ".join((r.text or "").split())) for r in near.collect()]
    assert sorted(left) == [(3, "b"), (7, "other text"), (7, words), (9, "")]
