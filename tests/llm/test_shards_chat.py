"""Shards and chat formatting."""

import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cardwatch.llm import chat, queries, shards


def shard_bytes(rows, n):
    sizes, slots = [0] * n, defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_sharding(spark, sf).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(want)
    sizes, largest = shard_bytes(rows, 24), max(s for s, _ in want.values())
    assert max(sizes) - min(sizes) <= 2 * largest
    assert torn_texts(rows, 24) <= 23


def torn_texts(rows, n):
    """Texts in more than one shard, of those that are smaller than a shard."""
    held, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        held[r.text_crc32, r.size].add(r.shard)
        sizes[r.text_crc32, r.size] += r.size
    return sum(len(s) > 1 for t, s in held.items() if sizes[t] < sum(sizes.values()) / n)


def test_copies_stay_together(spark):
    """3,000 texts of two to four copies each over all dimensions, and a text that holds a third of all rows."""
    copies = spark.range(3_000).select(F.explode(F.sequence(F.lit(0), F.col("id") % 3 + 1)).alias("copy"), F.col("id").alias("nr"))
    hot = spark.range(4_500).select(F.col("id").alias("copy"), F.lit(-1).alias("nr"))
    docs = copies.unionByName(hot).select(
        F.monotonically_increasing_id().alias("doc_id"),
        F.concat(F.lit("text "), F.col("nr").cast("string")).alias("text"),
        F.concat(F.lit("s"), (F.col("copy") % 7).cast("string")).alias("source"),
        (F.col("copy") * 13 % 11).alias("n"),
    )
    rows = shards.kd_shards(docs, 9, ["doc_id", "source", "n"]).collect()
    sizes = shard_bytes(rows, 9)
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 5 * 17
    assert torn_texts(rows, 9) <= 8


def test_hot_values_are_split(spark):
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("src0").alias("source"))
    sizes = shard_bytes(shards.kd_shards(docs, 7, ["source"]).collect(), 7)
    assert max(sizes) - min(sizes) <= 5 * 16


def test_shards_of_odd_rows(edge_docs, no_docs):
    rows = shards.kd_shards(edge_docs, 4, ["doc_id", "lang", "n_chars"]).collect()
    assert len(rows) == 15
    shard_bytes(rows, 4)
    assert shards.kd_shards(no_docs, 4, ["doc_id", "lang"]).count() == 0


@pytest.fixture(scope="module")
def formatted(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = spark.sql(
        f"""SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, CAST(array(
              named_struct('type','text','text','see [IMG:0] ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
              named_struct('type','image','text',null,'ref','a.png','width',28,'height',15,'seconds',null,'pages',null),
              named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null)) AS array<{part}>) AS parts
            UNION ALL SELECT 1L, 1, 'assistant', CAST(array(named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',2),
              named_struct('type','text','text','done','ref',null,'width',null,'height',null,'seconds',null,'pages',null)) AS array<{part}>)
            UNION ALL SELECT 1L, 2, null, null"""
    )
    return chat.format_conversations(rows).collect()[0]


def test_parts_become_placeholders(formatted):
    assert formatted.formatted == r"<s>[INST]see [\IMG:0] [IMG:0][AUD:1][/INST]</s><s>[OUT][DOC:2]done</s><s>[ROLE][/ROLE]</s>"
    assert [tuple(a) for a in formatted.attachments] == [(0, 0, "image", "a.png", 4), (1, 0, "audio", "b.wav", 38), (2, 1, "document", "c.pdf", 1024)]
    ((start, length),) = formatted.loss
    assert formatted.formatted[start : start + length] == "[DOC:2]done"


alphabet = st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", "[IMG:", "ROLE]", "a", "é", "\n", " "])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(alphabet, max_size=4).map("".join) | st.sampled_from(["user", "assistant", "system"]), st.lists(alphabet, max_size=12).map("".join)), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    row = done.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()[0]
    assert [tuple(t) for t in row.turns] == turns
    assert row.learned == "".join(text for role, text in turns if role == "assistant")


def test_odd_turns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (2, None, "assistant", "late"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "tool", "t")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert turns == {None: [("", ""), ("user", "x")], 2: [("assistant", "late"), ("user", ""), ("user", "")], 3: [("tool", "t")]}
    assert chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))).limit(0)).count() == 0
