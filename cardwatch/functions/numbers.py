"""Exact rounding, JSON numbers, lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(28,2)"


def ratio_half_up(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """numerator / denominator rounded half up, without passing through a double.

    Both sides are non-negative.  NULL when the denominator is 0 or NULL.
    """
    top, bottom = numerator.cast("decimal(28,4)"), denominator.cast("decimal(28,4)")
    steps = F.call_function("div", top * (2 * 10**digits) + bottom, bottom * 2)
    scaled = (steps.cast("decimal(18,0)") / F.lit(10**digits)).cast(f"decimal(18,{digits})")
    return F.when(bottom != 0, scaled)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio_half_up(part.cast("decimal(26,4)") * 100, whole, digits)


def percent_text(share: Column, digits: int = 4) -> Column:
    """0.1234 -> '12.3400%'."""
    return F.concat(F.round(share.cast("decimal(20,10)") * 100, digits).cast("string"), F.lit("%"))


def json_number(document: Column, key: str) -> Column:
    """A number stored under `key`; NULL when absent or not a number."""
    return F.get_json_object(document, f"$.{key}").try_cast("decimal(20,6)")


def list_contains(items: Column, item: Column) -> Column:
    """Membership where a missing list means no."""
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def map_get(mapping: Column, key: str, default: Column | float | None = None) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(mapping[key], fallback)


def class_label(flag: Column, positive: str = "suspect", negative: str = "clean") -> Column:
    return F.when(flag == 1, F.lit(positive)).otherwise(F.lit(negative))
