"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# [\x20\x09-\x0D] as one string, for trim()
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(df: DataFrame, size: Column, per_partition: int) -> int:
    """How many partitions keep each at about `per_partition` of `size` (one small aggregate)."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // per_partition))


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def give_back() -> None:
    """Hands freed memory back to the system: a worker outlives its stage, and would keep what it once took."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


class BatchCache(dict):
    """Results by key, computed for many missing keys at once.

    Holds at most `limit` short keys besides those of the current batch: past that the
    older ones go.
    """

    def __init__(self, compute_many, limit: int = 300_000, longest: int = 48) -> None:
        super().__init__()
        self.compute_many, self.limit, self.longest, self.long_keys = compute_many, limit, longest, []

    def need(self, keys: set) -> None:
        """Makes every one of `keys` present."""
        for key in self.long_keys:
            self.pop(key, None)
        missing = [key for key in keys if key not in self]
        if len(self) + len(missing) > self.limit:
            kept = {key: self[key] for key in keys if key in self}
            self.clear()
            self.update(kept)
        self.update(zip(missing, self.compute_many(missing)))
        self.long_keys = [key for key in missing if len(key) > self.longest]


def text_chunks(texts: list[str], most_chars: int = 1 << 20):
    """Consecutive texts with about `most_chars` together, so that their units fit in memory."""
    chunk, held = [], 0
    for text in texts:
        chunk.append(text)
        held += len(text)
        if held >= most_chars:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = [blank + " " for blank in _BLANKS]
# texts with a space that starts no unit
SPACE_BEHIND_BLANK = f"^ |[{_BLANKS}] "
_cut = re.compile(r"(?<=\S) ")


def space_units(text: str) -> list[str]:
    """The text cut at every space that follows a character other than white space.

    Under the patterns of byte-level tokenizers such a space always starts a new match,
    so the units (each but the first with its space put back in front) are independent.
    """
    if text.startswith(" ") or any(pair in text for pair in _PAIRS):
        return _cut.split(text)
    return text.split(" ")
