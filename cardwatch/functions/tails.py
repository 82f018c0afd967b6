"""Tail probabilities of test statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# terms that are enough for all digits of a double
_SERIES, _FRACTION, _ALTERNATING = 60, 120, 100
# below it the power series of the error function is used, above it the continued fraction of its complement
_SERIES_UPTO = 2.0


def _double(value: float) -> Column:
    return F.lit(float(value))


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0; null stays null."""
    square = x * x

    def next_term(done: Column, k: Column) -> Column:
        term = done["term"] * 2.0 * square / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (done["total"] + term).alias("total"))

    steps = F.sequence(F.lit(1), F.lit(_SERIES))
    power = F.aggregate(steps, F.struct(x.alias("term"), x.alias("total")), next_term, lambda done: done["total"])
    depth = F.sequence(F.lit(_FRACTION), F.lit(1), F.lit(-1))
    fraction = F.aggregate(depth, x, lambda below, k: x + k / 2.0 / below)
    scale = F.exp(-square) / math.sqrt(math.pi)
    return F.when(x < _SERIES_UPTO, 1.0 - 2.0 * scale * power).when(x.isNotNull(), scale / fraction)


def normal_tail(z: Column) -> Column:
    """Both tails of the standard normal distribution beyond |z|."""
    return erfc(F.abs(z.cast("double")) / math.sqrt(2.0))


def chi_square_tail(statistic: Column, freedom: Column) -> Column:
    """P(X > statistic) for whole degrees of freedom.

    The finite sum for even and odd degrees; terms are carried as logarithms, so that large statistics
    with many classes do not vanish.  Less than one degree or a missing statistic: null.
    """
    value = statistic.cast("double")
    half = F.when(value < 0, _double(0.0)).otherwise(value) / 2.0
    even = freedom % 2 == 0
    first = F.when(even, -half).otherwise(-half + F.ln(half) / 2.0 - math.lgamma(1.5))
    shift = F.when(even, _double(0.0)).otherwise(_double(0.5))

    def next_term(done: Column, k: Column) -> Column:
        return F.struct((done["log"] + F.ln(half / (k + shift))).alias("log"), (done["total"] + F.exp(done["log"])).alias("total"))

    terms = F.floor(F.when(even, freedom / 2).otherwise((freedom - 1) / 2)).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("log"), _double(0.0).alias("total")), next_term, lambda done: done["total"])
    own = F.when(even, _double(0.0)).otherwise(erfc(F.sqrt(half)))
    return F.when(freedom >= 1, F.when(half <= 0, _double(1.0)).when(half > 0, F.least(_double(1.0), own + total)))


def kolmogorov_tail(gap: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic probability of a gap at least as large between two samples; null without rows on a side."""
    size = F.sqrt(F.try_divide(n_ref * n_cur, n_ref + n_cur))
    x = (size + 0.12 + F.try_divide(_double(0.11), size)) * gap

    def next_term(total: Column, k: Column) -> Column:
        return total + F.when(k % 2 == 1, _double(2.0)).otherwise(_double(-2.0)) * F.exp(-2.0 * k * k * x * x)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_ALTERNATING)), _double(0.0), next_term)
    return F.when(x < 0.2, _double(1.0)).when(x.isNotNull(), F.greatest(_double(0.0), F.least(_double(1.0), series)))
