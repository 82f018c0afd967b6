"""Quality rules: fixed counts of a text and a calibrated linear model.

Logistic regression over hashed word and character n-grams, trained on a bounded sample of
labelled documents; a second, two-parameter regression on rows kept out of the first turns its
margins into probabilities.  Scoring runs in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import give_back, whole_text
from cardwatch.llm.features import labelled_sample, mean_scores, text_parts

TRAINING_ROWS = 4_000
BITS = 16
EPOCHS = 15
LEAST_STEPS = 500
RATE = 300.0
BATCH = 32
LEAST_PROBABILITY = 0.5
SYMBOLS = "#*$%&|<>"


class CalibratedRegression:
    """`weights` per hashed feature and `bias`; probability = sigmoid(slope * margin + shift)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> "CalibratedRegression":
        """Every fifth row calibrates; with fewer than five rows of a class all rows train and the margins stay as they are.

        With one class only, or none, everything gets that class, or class 1.
        """
        weights = np.zeros(1 << BITS)
        counts = np.bincount(labels, minlength=2)
        if counts.min() == 0:
            return cls(weights, 30.0 if counts[1] >= counts[0] else -30.0, 1.0, 0.0)
        random = np.random.default_rng(seed)
        shuffled = random.permutation(len(labels))
        shuffled = shuffled[np.argsort(labels[shuffled], kind="stable")]  # so that both parts have both classes
        is_calibration = (np.arange(len(labels)) % 5 == 0) & (counts.min() >= 5)
        train, calibration = shuffled[~is_calibration], shuffled[is_calibration]
        balance = len(train) / (2.0 * np.bincount(labels[train], minlength=2))
        per_epoch = -(-len(train) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
        bias, steps, done = 0.0, epochs * per_epoch, 0
        for _ in range(epochs):
            order = random.permutation(train)
            for at in range(0, len(order), BATCH):
                rate = RATE * (1 - done / steps)
                done += 1
                chosen = order[at : at + BATCH]
                features = np.concatenate([documents[i][0] for i in chosen])
                shares = np.concatenate([documents[i][1] for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), [len(documents[i][0]) for i in chosen])
                margins = np.bincount(owner, weights=weights[features] * shares, minlength=len(chosen)) + bias
                wrong = (_sigmoid(margins) - labels[chosen]) * balance[labels[chosen]] / len(chosen)
                np.add.at(weights, features, -rate * shares * wrong[owner])
                bias -= 0.01 * rate * wrong.sum()
        if not len(calibration):
            return cls(weights, bias, 1.0, 0.0)
        margins = np.array([weights[documents[i][0]] @ documents[i][1] for i in calibration]) + bias
        return cls(weights, bias, *_calibrated(margins, labels[calibration]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss against softened labels, by Newton's method."""
    n1 = labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    at = np.array([1.0, 0.0])
    inputs = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = _sigmoid(at @ inputs)
        slope = inputs @ (p - goal) + 1e-6 * at
        bend = (inputs * (p * (1 - p))) @ inputs.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return float(max(at[0], 1e-3)), float(at[1])


def fit_rules(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, text: str = "text", key: str = "doc_id") -> CalibratedRegression:
    """Fits on at most `rows` labelled documents, chosen by the hash of their id; labels are 0 and 1."""
    model = CalibratedRegression.fit(*labelled_sample(documents, labels, label, rows, BITS, text, key))
    give_back()  # the sample
    return model


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    data = text.encode()
    words = data.split()  # bytes split at [\x20\x09-\x0D] alone
    n_chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split()]
    return len(words), n_chars, n_symbols, len(lines) - len(set(lines)), _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice, its first place included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbered = np.fromiter((ids.setdefault(word, len(ids)) for word in words), np.int64, len(words))
    pairs = np.unique(numbered[:-1] * len(ids) + numbered[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * len(ids) + numbered[2:]
    _, window, times = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= repeated
    return int(covered.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_rule_columns(df: DataFrame, model: CalibratedRegression, least: float = LEAST_PROBABILITY, text: str = "text") -> DataFrame:
    """Adds the five counts, `base_failed`, `probability` and `kept` to `df`, over whole texts.

    Null is the empty text.  A text fails the base rules with fewer than 50 words or with more than half
    of its words in repeated 3-word windows; it is kept if it does not and `probability`, that of
    label 1, is at least `least`.  Columns of these names are replaced; all others pass through.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    names = (*COUNTS, "probability")

    @F.arrow_udf(f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},probability:double>")
    def judged(texts: pa.Array) -> pa.Array:
        model, counted, means = shared.value, [], [np.zeros(0)]
        for part in text_parts(texts):
            counted += map(text_counts, part)
            means.append(mean_scores(part, model.weights))
        counts = np.array(counted, np.int64).reshape(-1, len(COUNTS))
        give_back()
        probability = _sigmoid(model.slope * (np.concatenate(means) + model.bias) + model.shift)
        return pa.StructArray.from_arrays([*(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(probability)], list(names))

    out = df.withColumn("_judged", judged(whole_text(text)))
    out = out.withColumns({name: F.col("_judged")[name] for name in names}).drop("_judged")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))
