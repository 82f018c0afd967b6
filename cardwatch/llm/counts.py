"""Token counts without token ids."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import BatchCache, whole_text

_pretoken_cut = re.compile("(?<=[^ ]) ")


class PieceCounter:
    """Pieces per pre-token of a sentencepiece model, each distinct pre-token counted once.

    No piece of the model may have a space behind another character, and the model must put a
    space before the text and leave characters as they are: then each space that follows another
    character starts a pre-token that is merged on its own.  Anything else is refused.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("the model has pieces that go across pre-tokens")
        cut = [self._pieces(unit) for unit in (" a", "  \u212bb", "")]
        if self.model.encode(" a   \u212bb ", out_type=str) != sum(cut, []):
            raise ValueError("the model changes the text before it cuts it")
        self.known = BatchCache(self._count)

    def _pieces(self, unit: str) -> list[str]:
        return self.model.encode(unit, out_type=str) if unit else ["▁"]

    def _count(self, units: list[str]) -> list[int]:
        return [max(1, len(ids)) for ids in self.model.encode(units, num_threads=1)]

    def per_pretoken(self, distinct: list[str]) -> np.ndarray:
        self.known.need(set(distinct))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: its pre-tokens joined to the counts of the distinct ones, and summed."""
        plain = pc.replace_substring(texts, "▁", " ")
        units = pc.split_pattern(plain, " ")
        coded = units.flatten().dictionary_encode()
        sizes = self.per_pretoken(coded.dictionary.to_pylist())
        running = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy(zero_copy_only=False)])])
        ends = np.cumsum(pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64))
        total = running[ends] - running[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, np.int64)
        for i in np.flatnonzero(pc.match_substring_regex(plain, "^$|^ |  ").to_numpy(zero_copy_only=False)):
            text = plain[int(i)].as_py()
            total[i] = self.per_pretoken(_pretoken_cut.split(text)).sum() if text else 0
        return total


@lru_cache(4)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def with_token_counts(df: DataFrame, model_path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds `n_tokens`, how many tokens the model gives the whole text, begin and end left out.

    A null or empty text has 0.  An Arrow batch holds the pre-tokens of some documents; each
    distinct one is counted once per worker and joined to the documents' pre-tokens by its
    dictionary code, so nothing is shuffled.  A column already called `n_tokens` is replaced.
    """

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(model_path).totals(texts), pa.int64())

    return df.withColumn(n_tokens, counted(whole_text(text)))
