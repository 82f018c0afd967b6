"""Exact, line and near dedup against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardwatch.llm import dedup, jaccard, lines, queries
from check import connect, differences


@pytest.mark.parametrize("name", sorted(queries.LLM_ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(queries.LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), queries.LLM_ORACLE[name]) == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=80):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(top(i))) for i, r in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())


def test_near_copies_with_odd_rows(edge_docs, no_docs):
    assert found(edge_docs) == brute_components(edge_docs.collect())
    assert jaccard.near_duplicates(no_docs).count() == 0


def chain(n, step, seed):
    """Texts that each differ a little from the one before, so the ends differ much."""
    words = [f"w{seed}x{i}" for i in range(60)]
    for k in range(n):
        for j in range(step):
            words[(k * step + j) % 60] = f"n{seed}x{k}x{j}"
        yield " ".join(words)


def test_chains_passages_and_large_groups(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [t for seed in range(4) for t in chain(12, 1, seed)]
    texts += [f"{passage} " + " ".join(f"u{k}x{i}" for i in range(30)) for k in range(60)]
    texts += [f"{passage} tail{k} end" for k in range(80)]
    texts += [texts[-1]] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = brute_components(df.collect())
    assert found(df) == want
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 40)
    monkeypatch.setattr(jaccard, "RANGE_CHARS", 5_000)
    monkeypatch.setattr(jaccard, "FIRST_LEADERS", 1)
    assert found(df) == want


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_size_bands_hold_every_partner(spark, percent):
    """Whatever sizes and positions the length and the positional filter let pass, both sides' bands do as well."""
    size, place = F.col("size"), F.col("position")
    sides = spark.range(1, 60).select(F.col("id").alias("size")).withColumn("position", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))))
    sides = sides.filter(place <= size - F.ceil(size * percent / 100))
    low, high = jaccard.partner_sizes(size, place, percent)
    rows = sides.select("size", "position", jaccard.size_band(size), jaccard.size_band(low), jaccard.size_band(high)).collect()
    pairs = missed = 0
    for a in rows:
        for b in rows:
            rest = min(a[0] - a[1], b[0] - b[1])
            if 100 * min(a[0], b[0]) >= percent * max(a[0], b[0]) and (100 + percent) * rest >= percent * (a[0] + b[0]):
                pairs += 1
                missed += not (a[3] <= b[2] <= a[4] and b[3] <= a[2] <= b[4])
    assert pairs and missed == 0


def test_texts_of_one_passage_are_not_verified(spark, monkeypatch):
    """600 texts of 56 common shingles and 13 of their own each: none link, and none reach the verification."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(13))) for i in range(600)]
    docs += [(600 + i, docs[i][1] + " end") for i in range(30)]  # but these copies do
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    judged = []
    verified = jaccard.verified

    def counted(pairs, *rest):
        judged.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    rows = jaccard.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - 600 if i >= 600 else i for i in range(630)}
    assert sum(judged) <= 60


def test_cuckoo_filter_resizes_and_deletes():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5_000)]
    bucket = dedup.Bucket(None, {})
    for i, digest in enumerate(digests):
        bucket.insert(digest, (False, i, i), 1)
    assert bucket.resized > 0 and all(d in bucket.filter for d in digests)
    for digest in digests[:4_000]:
        bucket.delete(digest, 1)
    assert set(bucket.content) == set(digests[4_000:]) and all(d in bucket.filter for d in digests[4_000:])
    assert sum(d in bucket.filter for d in digests[:4_000]) < 40
    again = dedup.Bucket(bucket.filter.dump(), bucket.content)
    again.insert(digests[0], (False, 1, 1), 2)
    assert again.content[digests[0]][1] == 2


def test_index_over_batches(spark):
    digest = F.unhex(F.sha2(F.col("k").cast("string"), 256))
    rows = spark.range(1_000).select("id", F.col("id").alias("row"), (F.col("id") % 300).alias("k")).withColumn("digest", digest)
    index = dedup.DigestIndex(spark, 3).insert(rows.filter("id >= 500")).insert(rows.filter("id < 500"))
    content = index.content().collect()
    assert len(content) == 300 and {r.keep_id for r in content} == set(range(300)) and sum(r.group_size for r in content) == 1_000
    index.delete(rows.filter("k < 100")).delete(spark.range(5).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    assert index.content().count() == 200


def test_exact_copies_with_odd_rows(edge_docs, no_docs):
    rows = dedup.exact_duplicates(edge_docs).collect()
    plain = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in edge_docs.collect()]
    groups = Counter(text for _, text in plain)
    least = {text: min((i for i, t in plain if t == text and i is not None), default=None) for text in groups}
    want = Counter((i, least[t], groups[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in plain)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert dedup.exact_duplicates(no_docs).count() == 0


def test_lines_with_odd_rows(spark, edge_docs, no_docs):
    assert lines.drop_common_lines(no_docs).count() == 0
    same = lines.drop_common_lines(edge_docs, least_documents=3).collect()
    assert len(same) == 15
    assert all(r.n_dropped == r.n_lines and r.kept_text == "" for r in same if r.text and r.text.endswith("word28 word29") and r.doc_id != 11)
    assert all(r.n_dropped == 0 and r.kept_text == r.text for r in same if r.doc_id in (7, 8, 10, 11, 12))
    blank = [r for r in same if not r.text]
    assert all((r.n_lines, r.n_dropped, r.kept_text) == (1, 0, "") for r in blank)
    turkish = spark.createDataFrame([(i, "\tİx A \n" + str(i)) for i in range(3)] + [(9, "i̇x a")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.drop_common_lines(turkish, least_documents=3).collect()} == {0: 1, 1: 1, 2: 1, 9: 0}


def test_work_grows_with_the_lines(spark):
    """Documents of ten times the lines take far less than a hundred times as long."""
    import time

    def seconds(n):
        text = "\n".join(f"line number {i} of all" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(12)] + [(None, text)], "doc_id long, text string").repartition(4)
        started = time.time()
        rows = lines.drop_common_lines(docs).select("n_lines", "n_dropped", "kept_text").collect()
        assert all((r.n_lines, r.n_dropped, r.kept_text) == (n, n, "") for r in rows) and len(rows) == 13
        return time.time() - started

    seconds(100)
    assert seconds(20_000) < 8 * max(1.0, seconds(2_000))
