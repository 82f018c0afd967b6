"""Best-fit packing of token pieces into sequences of a fixed length.

Partitions pack what they hold; bins that are nearly full are finished, the others go on as
items of their own.  Tasks of the next round take the open bins of several tasks, until a
round closes no gap worth having.  A bin carries its pieces, so no round needs a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import give_back, whole_text
from cardwatch.session import durable

BINS_PER_TASK = 100_000
LONG_WORD = 2_000
MOST_BYTES = 4 << 20  # ids that a worker holds before it hands them on
PACKED_BYTES = 16 << 20  # bins that a task packs at a time


class WholeTextIds:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Texts of Latin characters go through tiktoken, several times as fast, with the ranks of the
    same file; the two libraries class some rarer characters differently, so all other texts, and those with
    very long words, go through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        if stored["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or stored["normalizer"]:
            raise ValueError("a plain byte-level tokenizer is asked for")
        special = {token["content"]: token["id"] for token in stored["added_tokens"]}
        byte_of = {char: byte for byte, char in enumerate(byte_characters())}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in stored["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        plain = text.isascii() or max(text) < "\u0250"
        if plain and max(map(len, text.split()), default=0) < LONG_WORD:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(byte if byte in visible else next(hidden)) for byte in range(256)]


@lru_cache(4)
def _text_ids(path: str) -> WholeTextIds:
    return WholeTextIds(path)


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each text's ids with `end_id` behind them.

    Documents of more than `capacity` ids are cut into pieces of `capacity`, of which only the first
    may be shorter.  `ids` are packed little-endian unsigned 32-bit integers.  A null or empty text
    is the end id alone.  Repeated keys and null keys give pieces of their own; other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = _text_ids(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        rows, held = [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                ids = coder.encode(text.as_py()).tobytes() + end
                cuts = [0, *range(len(ids) % step or step, len(ids) + 1, step)]
                rows += [(id_.as_py(), piece, a // 4, (b - a) // 4, ids[a:b]) for piece, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                held += len(ids)
                if held >= MOST_BYTES:
                    yield _piece_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _piece_batch(rows)
        del rows
        give_back()

    return df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), kinds)], [name for name, _ in kinds])


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: the longest first, each into the fullest bin it fits.

    Bins are numbered by the order in which they are opened.  The open residuals are one big
    integer, so the smallest sufficient residual is its lowest set bit.
    """
    bins = np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals, opened = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        above = residuals >> need
        if above:
            room = need + ((above & -above).bit_length() - 1)
            into = waiting[room].pop()
            if not waiting[room]:
                residuals ^= 1 << room
        else:
            room, into = capacity, opened
            opened += 1
        bins[item] = into
        left = room - need
        if left:
            waiting[left].append(into)
            residuals |= 1 << left
    return bins


def merged_bins(bins: pa.Table, capacity: int) -> pa.Table:
    """Best-fit of whole bins (columns filled, members): the members of a new bin follow each other."""
    filled = bins["filled"].to_numpy()
    into = best_fit(filled, capacity)
    order = np.argsort(into, kind="stable")
    counts = pc.list_value_length(bins["members"]).to_numpy(zero_copy_only=False).astype(np.int64)
    taken = bins["members"].combine_chunks().take(pa.array(order))
    per_bin = np.bincount(into, weights=counts).astype(np.int64) if len(into) else np.zeros(0, np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(per_bin)]), pa.int32())
    members = pa.ListArray.from_arrays(ends, taken.flatten(), type=bins.schema.field("members").type)
    total = np.bincount(into, weights=filled).astype(np.int64) if len(into) else np.zeros(0, np.int64)
    return pa.table({"filled": total, "members": members})


def packed_bins(items: DataFrame, capacity: int, spare: int = 4, least_gain: float = 0.001, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """Rows (bin, members): every item in exactly one bin of at most `capacity`.

    `items` has `length` (1 to capacity) and any other columns; `members` are all of them, in
    their order in the bin.  A bin with at most `spare` left over is finished.  A task packs at most
    `bins_per_task` open bins, or PACKED_BYTES of them, at a time; each round has as many tasks as the open bins ask for, and
    the last one is that of a single task or of a gain below `least_gain`.  No items give no bins.
    """
    spark = items.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema = f"filled bigint, members array<struct<{columns.replace('` ', '`:')}>>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= bins_per_task or size >= PACKED_BYTES:
                yield from merged_bins(pa.Table.from_batches(held), capacity).to_batches(1_000)
                held, rows, size = [], 0, 0
                give_back()
        if rows:
            yield from merged_bins(pa.Table.from_batches(held), capacity).to_batches(1_000)
        held.clear()
        give_back()

    single = items.select(F.col("length").cast("long").alias("filled"), F.array(F.struct(*items.columns)).alias("members"))
    finished = []
    before, current = None, single
    while True:
        done = durable(current.mapInArrow(pack, schema), "bins")
        full = F.col("filled") >= capacity - spare
        n_open = done.filter(~full).count()
        finished.append(done.filter(full))
        tasks = -(-n_open // bins_per_task)
        if not n_open or tasks == 1 and before == 1 or before is not None and n_open > before_open * (1 - least_gain):
            finished.append(done.filter(~full))
            break
        before, before_open = tasks, n_open
        current = done.filter(~full).coalesce(tasks)
    every = finished[0]
    for more in finished[1:]:
        every = every.union(more)
    return every.select(F.monotonically_increasing_id().alias("bin"), "members")


def pack_sequences(pieces: DataFrame, capacity: int, **options) -> DataFrame:
    """`pieces` (with `length`) and, for each, its `sequence_id` and its `offset` there, gapless from 0."""
    bins = packed_bins(pieces, capacity, **options)
    before = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda total, m: total + m["length"])
    return (
        bins.select("bin", "members", F.posexplode("members").alias("at", "member"))
        .select("member.*", F.col("bin").alias("sequence_id"), before.alias("offset"))
    )
