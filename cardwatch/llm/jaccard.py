"""Near copies by the Jaccard similarity of word shingles: a prefix-filtered set join.

Shingles are ordered rare first.  One that a single text has matches nothing, so a text whose
prefix is made of such shingles is out before any join; the others are joined on the shared
shingles of their prefixes, with length, positional and suffix filters, and verified once per pair.

1. Blocks of documents send each shingle to the task of its hash range: sorted hashes and the
   documents' numbers, packed.  A shingle that a block has in many documents is sent once with its
   count, and stays with the block's documents, so a hot shingle meets nowhere.
2. The task of a range counts documents per shingle and sends back those of two or more.
3. Back at its block, a document has its shared shingles in rare-first order.
4. Texts with the same set are one; prefixes of the rest are joined in rounds.  In a round each
   shingle has a few leaders, which are compared with the texts of other components; linked texts
   become one component, so a large group of near copies costs its size, not its square.
   Leaders grow eightfold a round until every text has been one: no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import give_back, partitions_for, whole_text
from cardwatch.session import durable

WORDS = 5
BLOCK_ROWS = 4_096
BLOCK_BYTES = 24 << 20
RANGE_CHARS = 8 << 20
FREQUENT = 64  # documents of one block from which on a shingle is frequent
FIRST_LEADERS, MORE_LEADERS = 4, 8
BINS = 16
HASH_BITS = 56
KNOWN_WORDS = 100_000  # hashes of words that a task remembers, about 0.2 KB each
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_RARE = np.iinfo(np.int64).max


def shingle_hashes(text: str, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (56 bits) of the shingles; one of all words if they are fewer."""
    each = text.encode().lower().split()  # on bytes both know ASCII alone
    if not each:
        return np.zeros(0, np.int64)
    for word in set(each).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, each), np.uint64, len(each))
    width = min(words, len(each))
    n = len(each) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(_PRIMES[k % len(_PRIMES)])
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-negative ascending integers as differences."""
    return pack(np.diff(values, prepend=0)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes as the largest needs; the first byte says how many."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + _planes(values, width)


def unpack(data: bytes) -> np.ndarray:
    return _from_planes(data[1:], data[0]) if data else np.zeros(0, np.int64)


def prefix_length(n: np.ndarray | int, percent: int):
    """Shingles of a set of n of which a partner must have one."""
    return n - (percent * n + 99) // 100 + 1


# What travels: kind 0 to a range (keys, documents), kind 1 a frequent key's count, kind 2 a document.
SENT = "target long, block long, kind int, keys binary, numbers binary, counts binary, id long, no_id boolean, size int, digest binary"
_SENT_ARROW = pa.schema(
    [("target", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("counts", pa.binary()),
     ("id", pa.int64()), ("no_id", pa.bool_()), ("size", pa.int32()), ("digest", pa.binary())]
)


def _sent(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SENT_ARROW)


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, for the ranges that have any."""
    target = ((keys >> (HASH_BITS - 32)) * ranges) >> 32
    starts = np.flatnonzero(np.diff(target, prepend=-1))
    return zip(target[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)])


def _block_rows(block: int, docs: list[tuple], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block; `docs` are (id, sorted hashes) and are let go on the way. Equal sets of the block travel once."""
    first_of: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    rows = []
    for number, (id_, keys) in enumerate(docs):
        digest = xxhash.xxh3_128_digest(keys.tobytes())
        if digest not in first_of:
            first_of[digest] = number
            sets.append(keys)
        rows.append({"target": number % ranges, "block": block, "kind": 2, "numbers": pack(np.array([number])), "id": id_, "no_id": id_ is None, "size": len(keys), "digest": digest})
    firsts = np.fromiter(first_of.values(), np.int64, len(first_of))
    keys = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(firsts.astype(np.int32), [len(s) for s in sets])
    docs.clear()
    sets.clear()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    owner = owner[order]
    del order
    changes = np.ones(len(keys), bool)
    changes[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(changes)
    counts = np.diff(np.append(starts, len(keys)))
    frequent = counts >= FREQUENT
    is_frequent = np.repeat(frequent, counts)
    kept = [[] for _ in rows]
    for key, number in zip(keys[is_frequent].tolist(), owner[is_frequent].tolist()):
        kept[number].append(key)
    for row, own in zip(rows, kept):
        row["keys"] = pack_sorted(np.array(own, np.int64))
    single, owner = keys[~is_frequent], owner[~is_frequent]
    for r, a, b in _by_range(single, ranges):
        rows.append({"target": r, "block": block, "kind": 0, "keys": pack_sorted(single[a:b]), "numbers": pack(owner[a:b])})
    hot, hot_counts = keys[starts[frequent]], counts[frequent]
    for r, a, b in _by_range(hot, ranges):
        rows.append({"target": r, "block": block, "kind": 1, "keys": pack_sorted(hot[a:b]), "counts": pack(hot_counts[a:b])})
    for at in range(0, len(rows), 2_000):
        yield _sent(rows[at : at + 2_000])


def _blocks(ranges: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        docs, held, part, block = [], 0, None, 0
        for batch in batches:
            for id_, text, partition in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = partition
                docs.append((id_, shingle_hashes(text, known, words)))
                held += 8 * len(docs[-1][1])
                if len(known) > KNOWN_WORDS:
                    known.clear()
                if len(docs) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    yield from _block_rows(part << 32 | block, docs, ranges)
                    docs, held, block = [], 0, block + 1
                    give_back()
        if docs:
            yield from _block_rows(part << 32 | block, docs, ranges)
        docs.clear()
        known.clear()
        give_back()

    return run


def _count_range(table: pa.Table) -> pa.Table:
    """What a range sends back to the blocks: their shingles of two or more documents, with counts; documents pass."""
    give_back()  # what the range before took
    kinds = table["kind"].to_numpy()
    out = table.filter(pa.array(kinds == 2)).select(["block", "kind", "keys", "numbers", "counts", "id", "no_id", "size", "digest"])
    shingles = table.filter(pa.array(kinds < 2))
    if not shingles.num_rows:
        return out
    packed, kinds = shingles.select(["block", "keys", "numbers", "counts"]).to_pylist(), shingles["kind"].to_numpy()
    keys = [unpack_sorted(r["keys"]) for r in packed]
    weights = [unpack(r["counts"]) if kind else np.ones(len(k), np.int64) for r, k, kind in zip(packed, keys, kinds)]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    _, inverse = np.unique(every, return_inverse=True)
    documents = np.bincount(inverse, weights=np.concatenate(weights)).astype(np.int64)
    by_block = np.bincount(inverse, weights=np.repeat(kinds, sizes)) > 0
    counts = np.where(by_block, _RARE, documents)[inverse]  # frequent somewhere: last in the order, by hash
    back, at = [], 0
    for row, own, kind, size in zip(packed, keys, kinds, sizes):
        mine = counts[at : at + size]
        at += size
        shared = mine > 1
        if kind == 0 and shared.any():
            numbers = unpack(row["numbers"])[shared]
            back.append({"block": row["block"], "kind": 0, "keys": pack_sorted(own[shared]), "numbers": pack(numbers), "counts": pack(np.where(mine[shared] == _RARE, 0, mine[shared]))})
    return pa.concat_tables([out, pa.Table.from_pylist(back, out.schema)]) if back else out


BACK = "block long, kind int, keys binary, numbers binary, counts binary, id long, no_id boolean, size int, digest binary"
SETS = "id long, no_id boolean, size int, digest binary, alone int, shared array<long>, bins array<int>"


def _rare_first(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Per document of a block: how many of its shingles are its own, the others rare first (if its prefix has any)."""
        give_back()  # what the block before took
        kinds = table["kind"].to_numpy()
        docs = table.filter(pa.array(kinds == 2)).to_pylist()
        keys, owner, counts = [], [], []
        for row in table.filter(pa.array(kinds == 0)).select(["keys", "numbers", "counts"]).to_pylist():
            keys.append(unpack_sorted(row["keys"]))
            owner.append(unpack(row["numbers"]))
            counts.append(unpack(row["counts"]))
        number_of = [int(unpack(d["numbers"])[0]) for d in docs]
        for number, d in zip(number_of, docs):
            own = unpack_sorted(d["keys"])
            keys.append(own)
            owner.append(np.full(len(own), number))
            counts.append(np.zeros(len(own), np.int64))
        keys, owner, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner, counts))
        counts = np.where(counts == 0, _RARE, counts)
        order = np.lexsort((keys, counts, owner))
        keys, owner = keys[order], owner[order]
        out = {name: [] for name in ("id", "no_id", "size", "digest", "alone", "shared", "bins")}
        for number, d in zip(number_of, docs):
            a, b = np.searchsorted(owner, [number, number + 1])
            alone = d["size"] - (b - a)
            has_prefix = d["size"] > 0 and alone < prefix_length(d["size"], percent)
            shared = keys[a:b] if has_prefix else None
            for name in ("id", "no_id", "size", "digest"):
                out[name].append(d[name])
            out["alone"].append(alone)
            out["shared"].append(shared)
            out["bins"].append(None if shared is None else np.bincount(shared >> (HASH_BITS - 4), minlength=BINS).astype(np.int32))
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], names=list(out))

    return run


def shared_shingles(df: DataFrame, percent: int, words: int, text: str, key: str) -> DataFrame:
    """One row per document: id, size of its set, digest of the set, shingles alone, the shared ones rare first.

    Documents that repeat a set of their block have no shared shingles here: the first has them.
    The input must be replayable in its order (a stored table), as its blocks are numbered by partition.
    """
    ranges = partitions_for(df, F.length(whole_text(text)), RANGE_CHARS)
    rows = df.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text"), F.spark_partition_id().alias("partition"))
    sent = rows.mapInArrow(_blocks(ranges, words), SENT)
    back = sent.groupBy("target").applyInArrow(_count_range, BACK)
    return back.groupBy("block").applyInArrow(_rare_first(percent), SETS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows that twice and keeps the edges
    between what is left; the rounds' mappings are then followed in turn.
    """
    maps = []
    edges = durable(edges.select("a", "b").filter("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooked = durable(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "hooks")
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            hooked = hooked.join(jump, "to").select("node", F.col("next").alias("to"))
        hooked = durable(hooked, "hooks")
        maps.append(hooked)
        left, right = (hooked.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")) for end in "ab")
        moved = edges.join(left, "a").join(right, "b").filter("a_to <> b_to")
        edges = durable(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("to", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return durable(found, "components")


def _least_overlap(percent: int) -> Column:
    """overlap >= this, times (100 + percent), is what the similarity asks of sizes a_size and b_size."""
    return percent * (F.col("a_size") + F.col("b_size"))


def size_band(size: Column) -> Column:
    """A number that grows with the size: sizes of one band differ by at most a tenth."""
    return F.floor(F.ln(size) / math.log(1.1)).cast("int")


def partner_sizes(size: Column, position: Column, percent: int) -> tuple[Column, Column]:
    """(smallest, largest) size of a set that a set of this size can link to, given a shared shingle at this position.

    From there on the set has `size - position` shingles, and they must hold the whole overlap: that bounds the largest.
    """
    by_place = F.floor(((100 + percent) * (size - position) - percent * size) / percent)
    return F.ceil(size * percent / 100), F.least(F.floor(size * 100 / percent), by_place)


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets (rep, size, alone, shared, bins) that link to another."""
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix_length_column(percent) - F.col("alone")))
    entries = sets.select("rep", "size", F.posexplode(prefix).alias("at", "token"), "alone")
    entries = entries.select("token", "rep", "size", (F.col("at") + F.col("alone")).alias("position"))
    groups = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    low, high = partner_sizes(F.col("size").cast("long"), F.col("position"), percent)
    entries = entries.withColumns({"band": size_band(F.col("size")), "low_band": size_band(low), "high_band": size_band(high)})
    entries = durable(entries.join(groups, "token"), "prefix-entries")
    seen: DataFrame | None = None
    links: DataFrame | None = None
    found: DataFrame | None = None
    leaders = FIRST_LEADERS
    spread = F.pmod(F.xxhash64("rep", F.lit("leader")), F.lit(1 << 30)) / (1 << 30)
    side = lambda end: [F.col(c).alias(f"{end}_{c}") for c in ("rep", "size", "position", "component")]
    while True:
        current = entries.withColumn("component", F.col("rep"))
        if found is not None:
            known = found.select(F.col("node").alias("rep"), F.col("component").alias("_found"))
            current = entries.join(known, "rep", "left").withColumn("component", F.coalesce("_found", "rep")).drop("_found")
        spans = current.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("most")).filter("low <> high")
        spans = durable(spans.select("token", "most"), "open-shingles")
        most = spans.agg(F.max("most")).first()[0]
        if most is None:
            break
        open_ = current.join(spans.select("token"), "token")
        # a leader goes only to the bands of sizes that it can link to, and takes from them only those that can link to it
        lead = open_.filter(spread * F.col("n") <= leaders).filter("low_band <= high_band")
        lead = lead.select("token", F.explode(F.sequence("low_band", "high_band")).alias("band"), F.col("band").alias("a_band"), *side("a"))
        other = open_.select("token", "band", "low_band", "high_band", *side("b"))
        met = lead.join(other, ["token", "band"]).filter("a_component <> b_component AND a_band BETWEEN low_band AND high_band")
        long_enough = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
        rest = F.least(F.col("a_size") - F.col("a_position"), F.col("b_size") - F.col("b_position"))
        in_place = (100 + percent) * rest >= _least_overlap(percent)
        pairs = met.filter(long_enough & in_place).select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = durable(pairs, "pairs")
        linked = durable(verified(pairs, sets, percent), "links")
        links = linked if links is None else links.union(linked)
        seen = pairs if seen is None else seen.union(pairs)
        found = components(links)
        if leaders >= most:
            break
        leaders *= MORE_LEADERS
    return sets.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0) if found is None else found


def prefix_length_column(percent: int) -> Column:
    return F.col("size") - F.ceil(F.col("size") * percent / 100) + 1


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of at least the similarity; only shared shingles can be in both.

    The suffix filter comes first: within each sixteenth of the hash space two sets have at
    most the smaller number of shingles in common.
    """
    small = [sets.select(*(F.col(c).alias(f"{end}_{c}") for c in ("rep", "size", "bins"))) for end in "ab"]
    full = [sets.select(*(F.col(c).alias(f"{end}_{c}") for c in ("rep", "shared"))) for end in "ab"]
    asked = _least_overlap(percent)
    bound = F.aggregate(F.zip_with("a_bins", "b_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    close = pairs.join(small[0], F.col("a") == F.col("a_rep")).join(small[1], F.col("b") == F.col("b_rep"))
    close = close.filter((100 + percent) * bound >= asked).select("a", "b", "a_size", "b_size")
    both = close.join(full[0], F.col("a") == F.col("a_rep")).join(full[1], F.col("b") == F.col("b_rep"))
    return both.filter((100 + percent) * F.size(F.array_intersect("a_shared", "b_shared")) >= asked).select("a", "b")


def near_duplicates(df: DataFrame, percent: int = 80, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two rows link when 100 * intersection >= percent * union of their sets of word shingles; A-Z are
    lower-cased, words are runs outside [\\x20\\x09-\\x0D].  With fewer words the whole sequence is one
    shingle; null and empty texts have none and link to nothing.  Rows of one id are one node of the
    graph only through their texts; a null id is never a component's id unless all of its rows have null ids.
    Other columns are left out.
    """
    every = durable(shared_shingles(df, percent, words, text, key), "shingle-sets")
    some = every.filter("size > 0")
    # of equal sets the smallest id stands for all
    classes = some.groupBy("digest").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("members"))
    classes = durable(classes, "set-classes")
    # an id can have several texts, so the nodes of the graph are sets, numbered when they are written
    sets = some.filter(F.col("shared").isNotNull() & (F.size("shared") > 0)).groupBy("digest").agg(
        *[F.min_by(c, F.struct("no_id", "id", "alone")).alias(c) for c in ("size", "alone", "shared", "bins")]
    )
    sets = durable(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    linked = linked_sets(sets, percent)
    groups = linked.join(sets.select(F.col("rep").alias("node"), "digest"), "node").join(classes, "digest")
    least = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    moved = groups.join(least, "component").select("digest", "component_id")
    named = classes.join(moved, "digest", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"), "members")
    total = max(1, every.count() // 1_000)
    hot = F.broadcast(named.filter(F.col("members") > total))  # fewer than 1,000 sets have so many rows
    cold = named.filter(F.col("members") <= total)
    has_set = F.col("size") > 0
    rows = every.select("id", "size", "digest")
    joined = rows.filter(has_set).join(hot, "digest").unionByName(rows.filter(has_set).join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    empty = rows.filter(~has_set).withColumns({"component_id": F.col("id"), "members": F.lit(1).cast("long")})
    return joined.unionByName(empty, allowMissingColumns=True).select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), "component_id")
