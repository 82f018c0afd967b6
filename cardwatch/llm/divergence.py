"""How far the word use of a source lies from that of its language and of its other sources.

All arithmetic is on whole numbers.  A term's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
two shares differ by f = floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.common import give_back, whole_text
from cardwatch.operators.hotkeys import attach_per_key
from cardwatch.session import durable

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
TOP = 10
# TERM byte for byte: a character above \x7F is made of bytes above \x7F, A-Z become a-z, the rest parts terms
_TERM_BYTES = bytes(b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
# counts that a task holds before it hands them on
HELD_COUNTS = 250_000


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeated as they are, with A to Z alone in lower case."""
    return text.translate(_TERM_BYTES).split()


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of the rows of a task; a term has several rows where its counts were handed on."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        langs, sources = (batch.column(name).to_pylist() for name in ("lang", "source"))
        for lang, source, text in zip(langs, sources, batch.column("text")):
            terms, (used, docs) = terms_of(text.as_py()), counts[lang, source]
            held -= len(used)
            used.update(terms)
            docs.update(set(terms))
            held += len(used)
            if held >= HELD_COUNTS:
                yield _counted(counts)
                counts.clear()
                held = 0
    yield _counted(counts)
    counts.clear()
    give_back()


def _counted(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows = [(lang, source, term, n, docs[term]) for (lang, source), (used, docs) in counts.items() for term, n in used.items()]
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "n_docs": pa.int64()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(values, kind) for values, kind in zip(columns, kinds.values())], names=list(kinds))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The share in parts of 10^9, exact: counts are multiplied as decimals of 38 digits."""
    scaled = F.lit(1_000_000_000).cast("decimal(38,0)") * (count + 2)
    return F.when(terms > 0, F.call_function("div", scaled, (total + 2 * terms).cast("decimal(38,0)")) + 1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n): occurrences of each kept term in a group and in its language.

    A language keeps the terms of at least `least_documents` of its rows; a group has a row for a term
    only where it occurs.  Texts are counted where they lie, before anything is shuffled.
    """
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_count_terms, "lang string, source string, term binary, n long, n_docs long")
    found = found.withColumn("term", F.col("term").cast("string"))
    counted = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    whole = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    counted = counted.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("n_docs").over(whole).alias("lang_docs"), F.min("source").over(whole).alias("_least"))
    kept = counted.filter(F.col("lang_docs") >= least_documents)
    return durable(kept.select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("_least")).alias("first_source")), "terms")


def group_totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (lang, source) that occurs, with N and the share of count 0 in group and language, and V."""
    groups = docs.select("lang", "source").distinct()
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    in_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first_source").cast("long")).alias("vocabulary"))
    zero = F.lit(0).cast("long")
    joined = groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    filled = joined.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "lang_total", "vocabulary")])
    return durable(filled.withColumn("none", _share(zero, F.col("total"), F.col("vocabulary"))), "groups")


def top_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, to rank `top`.

    Terms are first grouped into cells of equal (group count, language count), and f is evaluated once a
    cell.  Cells of equal value are merged; the values whose places begin within `top` are kept, by their
    cumulative multiplicity, and only the cells of those are expanded into terms, in UTF-8 order.
    """
    cells = counts.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("times")).join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("vocabulary")), _share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    cells = cells.select("lang", "source", "n", "lang_n", "times", p.alias("p"), q.alias("q")).filter("p > q")
    cells = durable(cells.select("lang", "source", "n", "lang_n", "times", difference(F.col("p"), F.col("q")).alias("value")), "cells")
    # each value stands for one term at least, so that the first `top` values suffice
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    values = values.withColumn("_level", F.row_number().over(by_value)).filter(F.col("_level") <= top)
    before = F.coalesce(F.sum("times").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = values.withColumn("_before", before).filter(F.col("_before") < top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    chosen = cells.join(least, ["lang", "source"]).filter("value >= least").select("lang", "source", "n", "lang_n", "value")
    expanded = counts.select("lang", "source", "n", "lang_n", F.col("term").alias("item")).join(chosen, ["lang", "source", "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return expanded.select("lang", "source", "item", "value", place.alias("rank")).filter(F.col("rank") <= top)


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): f summed over all kept terms, for each source and each other one.

    f is the same both ways.  Its sum is that of a term in neither source, times all terms; plus, for the
    terms of one source, what they change against a source without them, once for each count that occurs;
    plus, for the terms of both, what is left.  Only the last part looks at two rows of a term.
    """
    sized = groups.select(F.struct("lang", "source").alias("_group"), "n_terms", "total", "vocabulary", "none").filter("n_terms > 0")
    shares = attach_per_key(counts.select(F.struct("lang", "source").alias("_group"), "lang", "source", "term", "n"), sized, "_group", "n_terms")
    shares = durable(shares.select("lang", "source", "term", "none", _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p")), "shares")
    a, b = shares.alias("a"), shares.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    p, q, p0, q0 = F.col("a.p"), F.col("b.p"), F.col("a.none"), F.col("b.none")
    rest = difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)
    shared = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("one"), F.col("b.source").alias("other")).agg(F.sum(rest).alias("value"))

    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    same = shares.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("times")).join(others, "lang").filter("source <> item")
    change = F.col("times") * (difference(F.col("p"), F.col("item_none")) - difference(F.col("none"), F.col("item_none")))
    own = same.groupBy("lang", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("other")).agg(F.sum(change).alias("value"))

    empty = groups.join(others, "lang").filter("source < item")
    start = F.coalesce(F.col("vocabulary") * difference(F.col("none"), F.col("item_none")), F.lit(0))
    empty = empty.select("lang", F.col("source").alias("one"), F.col("item").alias("other"), start.alias("value"))
    pairs = empty.unionByName(own).unionByName(shared).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    both_ways = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    return both_ways.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): other sources (`pair`) and terms (`term`) of each source.

    `docs` has `text`, `lang` and `source`; null in one of them is the empty string, other columns are not
    read, every row is a document of its own, repeated or not.  A language without a kept term has value 0
    for its pairs and no `term` rows; a source alone in its language has no `pair` rows.  Equal values are
    ranked in UTF-8 order of the item.  No rows give no rows.
    """
    plain = docs.select(*[whole_text(name).alias(name) for name in ("text", "lang", "source")])
    counts = term_counts(plain, least_documents)
    groups = group_totals(plain, counts)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = source_pairs(counts, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(top_terms(counts, groups, top).withColumn("part", F.lit("term")).select(*columns))
