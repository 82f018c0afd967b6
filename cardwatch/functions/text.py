"""Hashes, labels and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def card_hash(cc_num: Column, length: int | None = None) -> Column:
    """SHA-256 of the card number's decimal text, optionally only its first characters."""
    digest = F.sha2(cc_num.cast("string"), 256)
    return digest if length is None else F.substring(digest, 1, length)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def version_label(version: Column | int) -> Column:
    return F.concat(F.lit("fraud_detector_v"), version if isinstance(version, Column) else F.lit(str(version)))


def strip_prefix(name: Column, prefix: str) -> Column:
    return F.regexp_replace(name, f"^{re.escape(prefix)}", "")


def leaf_name(name: Column) -> Column:
    """`onehot__category_travel` -> `category_travel`."""
    return F.substring_index(name, "__", -1)


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def run_model_type(run_name: Column) -> Column:
    return F.substring_index(run_name, "_", 1)


def run_ratio(run_name: Column) -> Column:
    """The number before a final `pc` part, else N/A."""
    tail = F.substring_index(run_name, "_", -1)
    return F.when(F.contains(tail, F.lit("pc")), F.replace(tail, F.lit("pc"), F.lit(""))).otherwise(F.lit("N/A"))


def bin_file_name(index: Column, start: Column) -> Column:
    """step_{two digits}_{start of the bin}."""
    number = F.when(index < 10, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.concat(F.lit("step_"), number, F.lit("_"), F.date_format(start, "yyyy-MM-dd_HH-mm"))
