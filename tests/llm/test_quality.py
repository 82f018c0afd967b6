"""Classifier and rules: held-out accuracy, counts against brute force, edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import classifier, queries, rules

SF = "/root/testdata/sf0.01"


def held_out_rates(rows, predicted):
    right = [predicted(r) == r.quality for r in rows]
    clean = [predicted(r) == 1 for r in rows if r.quality == 1]
    return np.mean(right), np.mean(clean)


def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op9_quality_classifier(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    accuracy, clean = held_out_rates(rows, lambda r: r.predicted)
    assert len(rows) > 50 and accuracy > 0.95 and clean > 0.98


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = queries.op4_quality_rules(spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in judged.collect():
        counts = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.kept and r.base_failed)
    rows = judged.filter(classifier.held_out() & ~F.col("base_failed")).join(labels, "doc_id").collect()
    accuracy, clean = held_out_rates(rows, lambda r: int(r.kept))
    assert accuracy > 0.95 and clean > 0.98


def test_odd_texts(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    for docs in (edge_docs, no_docs):
        model = classifier.fit_classifier(docs, labels)
        scores = [r.score for r in classifier.with_scores(docs, model).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
        judged = rules.with_rule_columns(docs, rules.fit_rules(docs, labels)).collect()
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text) for r in judged)
    assert classifier.with_scores(edge_docs, classifier.fit_classifier(no_docs, labels)).filter("score > 0.99").count() == 15


@pytest.mark.parametrize("n", [1 << 16, 3 << 20])
def test_long_text_scores_as_a_whole(n):
    from cardwatch.llm.features import mean_scores

    weights = np.random.default_rng(1).random(1 << 16)
    text = ("lorem ipsum dolor sit amet " * (n // 27))[:n]
    alone = mean_scores([text, "short one", text], weights)
    assert alone[0] == alone[2] and np.allclose(alone[1], mean_scores(["short one"], weights)[0])
    assert abs(alone[0] - mean_scores(["lorem ipsum dolor sit amet " * 2_000], weights)[0]) < 1e-3


@pytest.mark.parametrize("operator", ["classifier", "rules"])
def test_labelled_empty_documents(spark, edge_docs, operator):
    """A null, an empty and a blank text among the labelled ones do not fail the fit."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 0)], "doc_id long, quality int")
    if operator == "classifier":
        rows = classifier.with_scores(edge_docs, classifier.fit_classifier(edge_docs, labels)).collect()
        assert all(0 <= r.score <= 1 for r in rows)
    else:
        rows = rules.with_rule_columns(edge_docs, rules.fit_rules(edge_docs, labels)).collect()
        assert all(0 <= r.probability <= 1 for r in rows)
    assert len(rows) == edge_docs.count()


@pytest.mark.parametrize("texts", [[""], ["", ""], [None], ["a b c"] * 500 + [""]])
def test_batch_of_empty_texts(spark, texts):
    """Chunks of one or two bytes without a word have no n-grams: the score is that of the bias."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    weights, bias = np.ones((1 << classifier.BITS, 1)), np.array([0.0, 1.0])
    model = classifier.SubwordClassifier(weights, np.array([[0.0, 1.0]]), bias)
    scores = {r.doc_id: r.score for r in classifier.with_scores(docs, model).collect()}
    assert len(scores) == len(texts)
    for i, text in enumerate(texts):
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(2.0 if text else 1.0))))
    judged = rules.with_rule_columns(docs, rules.CalibratedRegression(np.zeros(1 << rules.BITS), 1.0, 1.0, 0.0)).collect()
    assert len(judged) == len(texts) and all(r.probability == pytest.approx(1 / (1 + np.exp(-1.0))) for r in judged)


@pytest.mark.parametrize("few", [1, 4])
@pytest.mark.parametrize("rare", [0, 1])
def test_rules_fit_a_rare_class(few, rare):
    """A class of fewer than five rows is still learned."""
    from cardwatch.llm.features import ngram_shares

    random = np.random.default_rng(3)

    def text(label):
        words = ["harvest", "river", "window", "garden"] if label else ["jackpot", "casino", "bonus", "payout"]
        return " ".join(random.choice(words, 80))

    labels = np.array([rare] * few + [1 - rare] * (200 - few))
    model = rules.CalibratedRegression.fit([ngram_shares(text(label), rules.BITS) for label in labels], labels)
    margins = np.array([weights @ shares for label in (0, 1) for features, shares in [ngram_shares(text(label), rules.BITS)] for weights in [model.weights[features]]]) + model.bias
    odds = rules._sigmoid(model.slope * margins + model.shift)
    assert odds[0] < rules.LEAST_PROBABILITY <= odds[1]
