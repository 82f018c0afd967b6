"""Quality classifier: supervised subword embeddings.

Hashed word and character n-grams have learned vectors; a document is the mean of its
vectors, a softmax layer gives the classes.  Trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import give_back, whole_text
from cardwatch.llm.features import labelled_sample, mean_scores, text_parts

TRAINING_ROWS = 2_000
BITS = 16
WIDTH = 6
EPOCHS = 6
LEAST_STEPS = 600
RATE = 30.0
BATCH = 16


class SubwordClassifier:
    """Two classes; `vectors` (features x width) and `output` (width x 2)."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray) -> None:
        self.vectors, self.output, self.bias = vectors, output, bias

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> "SubwordClassifier":
        """Classes weigh alike.  With one class only, or none, everything gets that class, or class 1."""
        random = np.random.default_rng(seed)
        columns = (random.random((WIDTH, 1 << BITS)) - 0.5) / WIDTH
        output, bias = random.random((WIDTH, 2)) - 0.5, np.zeros(2)
        counts = np.bincount(labels, minlength=2)
        if counts.min() == 0:
            return cls(np.zeros((1 << BITS, WIDTH)), np.zeros((WIDTH, 2)), np.array([0.0, 30.0 if counts[1] or not counts[0] else -30.0]))
        weight = len(labels) / (2.0 * counts)
        per_epoch = -(-len(labels) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
        steps, done = epochs * per_epoch, 0
        for _ in range(epochs):
            order = random.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rate = RATE * (1 - done / steps)
                done += 1
                chosen = order[at : at + BATCH]
                features = np.concatenate([documents[i][0] for i in chosen])
                shares = np.concatenate([documents[i][1] for i in chosen])
                ends = np.cumsum([len(documents[i][0]) for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), np.diff(ends, prepend=0))
                means = np.stack([np.bincount(owner, weights=column[features] * shares, minlength=len(chosen)) for column in columns], axis=1)
                logits = means @ output + bias
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                wrong = odds / odds.sum(axis=1, keepdims=True)
                wrong[np.arange(len(chosen)), labels[chosen]] -= 1
                wrong *= weight[labels[chosen]][:, None] / len(chosen)
                back = wrong @ output.T
                output -= 0.02 * rate * (means.T @ wrong)
                bias -= 0.002 * rate * wrong.sum(axis=0)
                for d, column in enumerate(columns):
                    column -= rate * np.bincount(features, weights=back[:, d][owner] * shares, minlength=len(column))
        return cls(columns.T, output, bias)

    def margin_weights(self) -> tuple[np.ndarray, float]:
        """The output is linear in the mean vector, so each feature has one number: its part of the log odds."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])

    def score(self, texts: list[str]) -> np.ndarray:
        weights, bias = self.margin_weights()
        return 1 / (1 + np.exp(-(mean_scores(texts, weights) + bias)))


def fit_classifier(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, text: str = "text", key: str = "doc_id") -> SubwordClassifier:
    """Fits on at most `rows` labelled documents, chosen by the hash of their id; labels are 0 and 1."""
    model = SubwordClassifier.fit(*labelled_sample(documents, labels, label, rows, BITS, text, key))
    give_back()  # the sample
    return model


def with_scores(df: DataFrame, model: SubwordClassifier, text: str = "text", score: str = "score") -> DataFrame:
    """Adds `score`, the probability of class 1, from the whole text; null is the empty text.

    A text without n-grams gets the score of the bias.  A column already called `score` is replaced.
    """
    weights, bias = model.margin_weights()
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))  # 2**BITS numbers

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        means = np.concatenate([np.zeros(0), *(mean_scores(part, weights) for part in text_parts(texts))])
        give_back()
        return pa.array(1 / (1 + np.exp(-(means + bias))))

    return df.withColumn(score, scored(whole_text(text)))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
