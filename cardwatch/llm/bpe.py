"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte b is written as the character U+0100 + b, every vocabulary entry becomes a
piece of such characters with its negative rank as score, and the normaliser is the
identity, so the merges of sentencepiece are the merges of the rank file.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import SPACE_BEHIND_BLANK, give_back, space_units, whole_text

_BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
_CODES = np.arange(0x100, 0x200, dtype="<u2")
# put between units that are cut together; behind it, and in front of it, every match ends
_MARK = "\x0b"
# characters below are classed alike by `regex` and by the rank format's library
_LATIN_END = "\u0250"
# bytes of text whose units are numbered together
CHUNK_BYTES = 8 << 20
# values of the sentencepiece model format
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _mapped(data: bytes) -> str:
    return "".join(map(_BYTE_CHARS.__getitem__, data))


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model in which piece number r is the entry of rank r."""
    by_rank = sorted(ranks.items(), key=lambda entry: entry[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [
        _block(1, _block(1, _mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, _NORMAL))
        for token, rank in by_rank
    ]
    unknown = _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, _UNKNOWN))
    trainer = _block(2, _number(3, _BPE) + _number(40, len(by_rank)))
    identity = _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + unknown + trainer + identity


def _byte_strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings of the given sizes, one behind the other in `data`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lists_of(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring byte strings joined: the n-th result ends before value `ends[n]`; no byte is copied."""
    _, offsets, data = values.buffers()
    starts = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    joined = starts[np.concatenate([[0], ends])]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(joined), data])


def _place_back(parts: list[pa.Array], places: list[np.ndarray]) -> pa.Array:
    """The rows of all parts in the order of their places."""
    at = np.concatenate(places)
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    return pa.concat_arrays(parts).take(pa.array(order))


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


class BytePairs:
    """Encodes and decodes with one rank file; `pattern` cuts a text into pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.split = regex.compile(pattern)
        self.vocabulary = pa.array(sorted(self.ranks, key=self.ranks.__getitem__), pa.large_binary())
        whole = {}  # a pre-token is whole characters
        for token, rank in self.ranks.items():
            try:
                whole[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        self.whole = pa.array(list(whole), pa.string())
        self.whole_ranks = np.fromiter(whole.values(), "<u4")
        letters = "".join(char for char in map(chr, range(ord(_LATIN_END))) if regex.match(r"\p{L}", char))
        self.word, self.word_and_stop = f"^[{letters}]+$", f"^[{letters}]+[.,]$"
        if self.split.findall(f"{_MARK}aé bé{_MARK} à. ª,{_MARK} b{_MARK}.") != [_MARK, "aé", " bé", _MARK, " à", ".", " ª", ",", _MARK, " b", _MARK, "."]:
            raise ValueError("the pattern must take a space, letters, stops and blanks as separate matches")

    def _merged(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pre-tokens that are not entries of the vocabulary."""
        data = "".join(pieces.to_pylist()).encode()
        mapped = _CODES[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le")
        ends = np.cumsum(_lengths(pieces)).tolist()
        ids = self.model.encode([mapped[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
        return _byte_strings(4 * sizes, flat)

    def _piece_ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pre-tokens: an entry of the vocabulary is not merged, as in the rank format's library."""
        entry = pc.index_in(pieces, value_set=self.whole)
        known = pc.is_valid(entry).to_numpy(zero_copy_only=False)
        ranks = self.whole_ranks[entry.drop_null().to_numpy()]
        parts = [_byte_strings(np.full(len(ranks), 4), ranks)]
        if not known.all():
            parts.append(self._merged(pieces.filter(pa.array(~known))))
        return _place_back(parts, [np.flatnonzero(known), np.flatnonzero(~known)])

    def _cut(self, unit: str) -> list[str]:
        """The matches of one unit; characters that `regex` classes in its own way stand for others meanwhile."""
        if not unit or max(unit) < _LATIN_END:
            return self.split.findall(unit)
        return [unit[m.start() : m.end()] for m in self.split.finditer(unit.translate(_class_differences()))]

    def _cut_units(self, units: list[str]) -> list[list[str]]:
        """The matches of each unit.

        Units that neither begin (behind their space) nor end with white space are cut in one go, with a mark between them.
        """
        cut: list[list[str]] = [[] for _ in units]
        together = []
        for n, unit in enumerate(units):
            body = unit[1:] if unit.startswith(" ") else unit
            if body and not body[0].isspace() and not body[-1].isspace() and _MARK not in body and (body.isascii() or max(body) < _LATIN_END):
                together.append(n)
            else:
                cut[n] = self._cut(unit)
        at, here = iter(together), []
        for piece in self.split.findall(_MARK + _MARK.join([units[n] for n in together])) if together else []:
            if piece == _MARK:
                here = cut[next(at)]
            else:
                here.append(piece)
        return cut

    def _cut_ids(self, units: list[str]) -> pa.Array:
        """Ids of units that the pattern must cut."""
        cut = self._cut_units(units)
        coded = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        return _lists_of(self._piece_ids(coded.dictionary).take(coded.indices), np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))

    def _unit_ids(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units, each behind a space: Latin words, alone or with a stop, are known by their form."""
        word, stopped = (pc.match_substring_regex(units, form) for form in (self.word, self.word_and_stop))
        rest = pc.invert(pc.or_(word, stopped))
        spaced = pc.binary_join_element_wise("", pc.if_else(stopped, pc.utf8_slice_codeunits(units, 0, -1), units), " ")
        stops = pc.utf8_slice_codeunits(units.filter(stopped), -1).dictionary_encode()
        words = spaced.filter(pc.or_(word, stopped)).dictionary_encode()
        word_ids = self._piece_ids(words.dictionary).take(words.indices)
        ends_word = word.filter(pc.invert(rest))
        stop_ids = self._piece_ids(stops.dictionary).take(stops.indices)
        parts = [word_ids.filter(ends_word), pc.binary_join_element_wise(word_ids.filter(pc.invert(ends_word)), stop_ids, pa.scalar(b"", pa.large_binary()))]
        parts.append(self._cut_ids([" " + unit for unit in units.filter(rest).to_pylist()]))
        return _place_back(parts, [np.flatnonzero(mask.to_numpy(zero_copy_only=False)) for mask in (word, stopped, rest)])

    def _text_ids(self, units: pa.Array, sizes: np.ndarray) -> pa.Array:
        """Ids of texts given as their units: units are numbered, the distinct ones encoded, and ids taken by number."""
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        coded = units.dictionary_encode()
        first = units.take(pa.array(firsts)).dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[firsts] = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(coded.dictionary)
        table = pa.concat_arrays([self._unit_ids(coded.dictionary), self._cut_ids(first.dictionary.to_pylist())])
        return _lists_of(table.take(pa.array(numbers)), ends)

    def _chunk_ids(self, texts: pa.Array) -> pa.Array:
        apart = pc.match_substring_regex(texts, SPACE_BEHIND_BLANK)
        odd = apart.to_numpy(zero_copy_only=False)
        units = pc.split_pattern(texts.filter(pc.invert(apart)), " ")
        sizes = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = [space_units(text) for text in texts.filter(apart).to_pylist()]
        flat = pa.concat_arrays([units.flatten(), pa.array(chain.from_iterable(cut), pa.string())])
        sizes = np.concatenate([sizes, np.fromiter(map(len, cut), np.int64, len(cut))])
        return _place_back([self._text_ids(flat, sizes)], [np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])])

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ends, start, done = np.cumsum(_lengths(texts)), 0, [pa.array([], pa.large_binary())]
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES)))
            done.append(self._chunk_ids(texts.slice(start, stop - start)))
            start = stop
        return pa.concat_arrays(done)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def decode_array(self, packed: pa.Array) -> pa.Array:
        """The bytes of each row's ids; an id that is not in the vocabulary is an error."""
        rows = packed.cast(pa.large_binary())
        ids = np.frombuffer(b"".join(row.as_buffer() for row in rows if row.is_valid), "<u4").astype(np.int64)
        if len(ids) and ids.max() >= len(self.vocabulary):
            raise ValueError(f"id {ids.max()} is not in the vocabulary")
        ends = np.cumsum(pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        decoded = _lists_of(self.vocabulary.take(pa.array(ids)), ends)
        return pc.if_else(rows.is_valid(), decoded, pa.scalar(None, pa.large_binary()))

    def decode(self, ids: bytes) -> bytes:
        return self.decode_array(pa.array([ids], pa.binary()))[0].as_py()


@lru_cache
def _class_differences() -> dict[int, str]:
    """Characters that `regex` and tiktoken class differently (Unicode versions), with one of the right class."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0x250, 0xD800), *range(0xE000, 0x110000)]))
    single_bytes = {bytes([b]): b for b in range(256)}
    stands_for = {}
    for name, char in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\x0b"), (r"[^\s\p{L}\p{N}]", "!")):
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single_bytes, special_tokens={})
        theirs = set(bytes(coder.encode_ordinary(every)).decode())
        stands_for |= {ord(c): char for c in theirs.difference(regex.findall(name, every))}
    return stands_for


@lru_cache(4)
def _byte_pairs(ranks_path: str, pattern: str) -> BytePairs:
    return BytePairs(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`, the token ids of `text` as packed little-endian unsigned 32-bit integers.

    Each match of `pattern` is encoded separately; there are no special tokens.  A null or empty
    text has no ids.  A column already called `ids` is replaced; all others pass through.
    `ranks_path` must name the file on every worker.
    """

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        ids = _byte_pairs(ranks_path, pattern).encode_array(texts).cast(pa.binary())
        give_back()
        return ids

    return df.withColumn(ids, encoded(whole_text(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`, the bytes that the packed `ids` stand for; null ids give null, an id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def restored(packed: pa.Array) -> pa.Array:
        return _byte_pairs(ranks_path, pattern).decode_array(packed).cast(pa.binary())

    return df.withColumn(decoded, restored(F.col(ids)))


def n_ids(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
