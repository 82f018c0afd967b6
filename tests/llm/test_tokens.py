"""Token operators against the tokenizers' own libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import bpe, counts, pack, queries

RANKS = tokenizers_files.path("byte_bpe_multi_50k.tiktoken")
MODEL = tokenizers_files.path("piece_bpe_32k.model")
JSON = tokenizers_files.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(RANKS, tokenizers_files.PATTERN)


odd_text = st.text(st.one_of(st.sampled_from(" ab'se1.,!\n\t\x1c\x85　▁"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_ids_are_the_librarys(coder, library, text):
    (ids,) = coder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_counts_are_the_librarys(text):
    import pyarrow as pa

    assert counts._counter(MODEL).totals(pa.array([text])).tolist() == [len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text))]


@settings(max_examples=200, deadline=None)
@given(odd_text | st.just("a <|endoftext|>  b<|endoftext|>"))
def test_packed_ids_are_the_librarys(text):
    units = pack._text_ids(JSON)
    assert units.encode(text).tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_and_rare_words_are_packed_alike():
    units = pack._text_ids(JSON)
    for text in ("x" * 5_000, "é" * 3_000 + " b", "日本語 " * 50, "Straße\n\n  a\u00a0b <|endoftext|>  c" * 20, "y" * 1_999):
        assert units.encode(text).tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids


def test_op1(spark, sf_dir, documents, library):
    want = {}
    for row in documents.collect():
        ids = np.array(library.encode_ordinary(row.text or ""), "<u4")
        want[row.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    have = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, sf_dir).collect()}
    assert have == want


def test_op5(spark, sf_dir, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r.doc_id: (len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in documents.collect()}
    have = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op5_token_counts(spark, sf_dir).collect()}
    assert have == want


def placed_right(rows, capacity):
    """Sequences are gapless from 0 and within the capacity; returns how many there are."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_op2(spark, sf_dir, documents):
    tokenizer, want = Tokenizer.from_file(JSON), set()
    for row in documents.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(row.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = queries.op2_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    lengths = np.array([r.length for r in rows])
    assert placed_right(rows, 1024) <= pack.best_fit(lengths, 1024).max() + 1 + 4


def test_packing_in_rounds(spark):
    lengths = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(100)) + 1).alias("length"))
    rows = pack.pack_sequences(lengths.repartition(6), 100, spare=0, bins_per_task=300).collect()
    assert len(rows) == 5_000
    least = -(-sum(r.length for r in rows) // 100)
    assert placed_right(rows, 100) <= 1.03 * least


def test_edges(edge_docs, no_docs, library):
    for docs, n in ((edge_docs, 15), (no_docs, 0)):
        ids = bpe.decode(bpe.encode(docs, RANKS, tokenizers_files.PATTERN), RANKS, tokenizers_files.PATTERN).collect()
        assert len(ids) == n and all(bytes(r.decoded) == (r.text or "").encode() for r in ids)
        counted = counts.with_token_counts(docs, MODEL).collect()
        assert len(counted) == n and all((r.n_tokens == 0) == (not r.text) for r in counted) and all(r.kept == "clash" for r in counted)
        pieces = pack.token_pieces(docs, JSON, 2, 1024)
        assert pieces.filter("piece = 0").count() == n
        placed_right(pack.pack_sequences(pieces.drop("ids"), 1024).collect(), 1024)


def test_batches_keep_their_order(coder, library, monkeypatch):
    texts = ["", "one two", " led by a space", "a  b", "x" * 3_000, "tab \t and\n line", "é. ù, 日本 語", "", "end "] * 7
    for size in (1 << 20, 64, 1):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", size)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert coder.encode([]) == []


def test_unknown_ids_are_refused(coder):
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode(np.array([1, 10**6], "<u4").tobytes())
    assert coder.decode_array(bpe.pa.array([None, b"", np.array([5], "<u4").tobytes()], bpe.pa.binary())).null_count == 1
