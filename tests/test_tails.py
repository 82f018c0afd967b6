"""Tail probabilities against the closed forms of the standard library and against exact series."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import tails
from cardwatch.operators import drift


def test_erfc_to_the_last_digits(spark):
    xs = [i / 16 for i in range(0, 16 * 12)] + [1.9999, 2.0, 2.0001, 26.0]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", tails.erfc(F.col("x")).alias("y")).collect()
    for row in got[:-1]:
        assert row.y == pytest.approx(math.erfc(row.x), rel=1e-12, abs=1e-300)
    assert got[-1].y is None


def chi_square(x: float, freedom: int) -> float:
    """1 - P(freedom/2, x/2) by the series of the lower incomplete gamma function."""
    a, half = Fraction(freedom, 2), Fraction(x) / 2
    term = total = 1 / a
    for k in range(1, 600):
        term = Fraction(float(term * half / (a + k)))
        total += term
    return 1.0 - math.exp(-float(half) + float(a) * math.log(float(half)) - math.lgamma(float(a))) * float(total)


def test_chi_square(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 7, 14, 33) for x in (0.01, 0.5, 3.0, 12.5, 40.0)]
    rows = spark.createDataFrame(cases, "x double, k int").select("x", "k", tails.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(chi_square(row.x, row.k), abs=1e-10)


def test_chi_square_ends(spark):
    rows = [(0.0, 1), (0.0, 6), (None, 3), (5.0, 0), (1e5, 3), (2000.0, 2000)]
    got = [r.p for r in spark.createDataFrame(rows, "x double, k int").select(tails.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()]
    assert got[:5] == [1.0, 1.0, None, None, 0.0] and 0.48 < got[5] < 0.5


def test_kolmogorov(spark):
    cases = [(g, float(n), float(m)) for g in (0.001, 0.02, 0.1, 0.5, 1.0) for n, m in ((1000, 1000), (30, 700), (1, 1))]
    rows = spark.createDataFrame([*cases, (0.4, 0.0, 9.0), (None, 5.0, 5.0)], "g double, n double, m double")
    got = [r.p for r in rows.select(tails.kolmogorov_tail(F.col("g"), F.col("n"), F.col("m")).alias("p")).collect()]
    for (g, n, m), p in zip(cases, got):
        size = math.sqrt(n * m / (n + m))
        x = (size + 0.12 + 0.11 / size) * g
        want = 1.0 if x < 0.2 else 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
        assert p == pytest.approx(min(1.0, max(0.0, want)), abs=1e-12)
    assert got[-2:] == [None, None]


def test_missing_parts_do_not_drift(spark):
    """Without current rows no test can be made: no p-value, no alarm."""
    tagged = spark.createDataFrame([("reference", float(i), "ab"[i % 2]) for i in range(40)], "part string, amt double, gender string")
    rows = {r.column_name: r for r in drift.drift_head_tail(tagged, ["amt"], ["gender"]).collect()}
    assert rows["amt"].metric_value is None and not rows["amt"].drift_detected
    assert not rows["gender"].drift_detected and not rows["gender"].dataset_drift
