"""Hashed word and character n-grams of whole texts, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import whole_text

CHAR_NGRAMS = (3, 4)
WORD_NGRAMS = (1, 2)
CHUNK_BYTES = 1 << 18  # hashing takes about 150 bytes of memory a byte of text
ROWS_AT_A_TIME = 500
_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    n = CHUNK_BYTES + 1
    power, back = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    power[0] = back[0] = 1
    return np.cumprod(power), np.cumprod(back)


def _bucket(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(_MULTIPLIER)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_BASE)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def hashed_ngrams(data: np.ndarray, owner_ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every n-gram of texts laid end to end in `data`, each ended by a newline.

    Words are runs of bytes above the space; the n-grams of bytes and of words do not cross texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(owner_ends)), np.diff(owner_ends, prepend=0))
    owners, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a chunk may have no n-gram at all
    wide = data.astype(np.uint64)
    for size in CHAR_NGRAMS:
        if n < size:
            continue
        key = wide[: n - size + 1].copy()
        for k in range(1, size):
            key |= wide[k : n - size + 1 + k] << np.uint64(8 * k)
        same = owner[: n - size + 1] == owner[size - 1 :]
        owners.append(owner[: n - size + 1][same])
        features.append(_bucket(key[same], size, bits))
    power, back = _powers()
    # hash of a word: its bytes times falling powers, from differences of a running sum
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * power[:n])])
    letters = np.concatenate([[False], data > 32, [False]])
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    starts, ends = edges[::2], edges[1::2]
    words = (running[ends] - running[starts]) * back[starts]
    of = owner[starts] if len(starts) else np.zeros(0, np.int64)
    for size in WORD_NGRAMS:
        if len(words) < size:
            continue
        key = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            key = key * np.uint64(_BASE) + words[k : len(words) - size + 1 + k]
        if size > 1:  # a word said again and again is one feature, whatever the word
            key[np.all([words[k : len(words) - size + 1 + k] == words[: len(words) - size + 1] for k in range(1, size)], axis=0)] = 0
        same = of[: len(words) - size + 1] == of[size - 1 :]
        owners.append(of[: len(words) - size + 1][same])
        features.append(_bucket(key[same], 100 + size, bits))
    return np.concatenate(owners), np.concatenate(features)


def _chunks(texts: list[str]):
    """Texts as (first number, bytes, ends) with at most CHUNK_BYTES together; a longer text comes in parts."""
    held, ends, first, size = [], [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode() + b"\n"
        if size and size + len(data) > CHUNK_BYTES:
            yield first, b"".join(held), np.array(ends)
            held, ends, size = [], [], 0
        if not size:
            first = i
        while len(data) > CHUNK_BYTES:
            # cut behind a white space, so that words stay whole; a word beyond the limit is cut
            at = max(data.rfind(b" ", 0, CHUNK_BYTES), data.rfind(b"\n", 0, CHUNK_BYTES)) + 1 or CHUNK_BYTES
            yield i, data[:at], np.array([at])
            data = data[at:]
            first = i
        held.append(data)
        size += len(data)
        ends.append(size)
    if held:
        yield first, b"".join(held), np.array(ends)


def text_parts(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, a few rows at a time, so that they do not stand in memory a second time."""
    for at in range(0, len(texts), ROWS_AT_A_TIME):
        yield texts.slice(at, ROWS_AT_A_TIME).to_pylist()


def mean_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight over all n-grams of each text; 0 for a text without any."""
    bits = len(weights).bit_length() - 1
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for first, data, ends in _chunks(texts):
        owners, features = hashed_ngrams(np.frombuffer(data, np.uint8), ends, bits)
        total[first : first + len(ends)] += np.bincount(owners, weights=weights[features], minlength=len(ends))
        count[first : first + len(ends)] += np.bincount(owners, minlength=len(ends))
    return total / np.maximum(count, 1)


def ngram_shares(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and the share of its n-grams that each has."""
    counts: dict[int, int] = {}
    parts = []
    for _, data, ends in _chunks([text]):
        parts.append(hashed_ngrams(np.frombuffer(data, np.uint8), ends, bits)[1])
    features, counts = np.unique(np.concatenate(parts), return_counts=True)
    return features.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, bits: int, text: str = "text", key: str = "doc_id"):
    """Features and labels of at most `rows` labelled documents: (list of (features, shares), labels).

    The rows are those whose id has the smallest hash, so the same ones each time.  Null labels,
    null ids and labels without a document are left out; a repeated id counts once per distinct label row.
    """
    spark = documents.sparkSession
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    chosen = usable.orderBy(F.xxhash64("_id", F.lit("sample")), "_id", "_label").limit(rows)

    @F.arrow_udf("struct<features:array<int>,shares:array<float>>")
    def features(texts: pa.Array) -> pa.Array:
        both = [ngram_shares(value, bits) for value in texts.to_pylist()]
        kinds = ("features", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))
        return pa.StructArray.from_arrays([pa.array([b[i] for b in both], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    narrow = documents.select(F.col(key).alias("_id"), whole_text(text).alias("_text"))
    # at most `rows` ids are broadcast
    found = narrow.join(F.broadcast(chosen), "_id").select("_id", "_label", features(F.col("_text")).alias("f")).select("_id", "_label", "f.*")
    table = found.toArrow()
    pairs = list(zip(_slices(table["features"]), _slices(table["shares"])))
    ids, kinds = table["_id"].to_numpy(), table["_label"].to_numpy().astype(np.int64)
    order = np.lexsort((kinds, ids))
    return [pairs[i] for i in order], kinds[order]


def _slices(lists: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists as views of the stored values: the driver holds the sample once."""
    for chunk in lists.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from map(values.__getitem__, map(slice, ends[:-1], ends[1:]))
