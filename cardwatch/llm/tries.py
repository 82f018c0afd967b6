"""The prefix trie of conversations that are rebuilt from a shared head and their own later turns.

A sequence of turns has the fingerprint sum(t_j * B^j) modulo a prime, t_j drawn from the SHA-256 of turn
j.  Fingerprints with lengths are a monoid: (S, m) followed by (T, n) is (S + B^m T, m + n).  So the
fingerprint of a rebuilt prefix comes from that of its base's head and from two running fingerprints of its own
conversation, and no rebuilt text is ever put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import partitions_for, whole_text
from cardwatch.operators.hotkeys import attach_per_key
from cardwatch.operators.ranges import PART, PLACE, RANGE_ROWS, in_ranges, with_running
from cardwatch.session import durable

# the largest primes below 2^31, and the bases of the attempts
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = ((1_103_515_245, 1_664_525_077, 1_566_083_941), (1_812_433_253, 1_597_334_677, 1_181_783_497), (1_327_217_885, 1_540_483_477, 1_274_126_177))
BLOCK, LONGEST_HEAD = 100, 5
_TIE_CHARS = 64
_WORDS = ("w0", "w1", "w2", "w3")  # the SHA-256 of a turn, 64 bits each
_SUMS = ("s0", "s1", "s2")
_NODE = ("depth", "fa", "fb")


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base^exponent modulo prime for exponents below 2^31, by their binary digits."""
    result, square = F.lit(1).cast("long"), base
    for bit in range(31):
        factor = F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, square).otherwise(1)
        result, square = F.pmod(result * factor, F.lit(prime)), square * square % prime
    return result


def _shifted_back(value: Column, places: Column, base: int, prime: int) -> Column:
    """value / base^places modulo prime, for up to LONGEST_HEAD places."""
    inverse = F.array(*[F.lit(pow(base, -n, prime)).cast("long") for n in range(LONGEST_HEAD + 1)])
    return F.pmod(value * F.element_at(inverse, places.cast("int") + 1), F.lit(prime))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % (LONGEST_HEAD + 1)).cast("long")


def stored_turns(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Turns by number: conv_id, pos from 1, the SHA-256 of role and text as four numbers, code points; in ranges.

    A conversation that holds a large share of the rows lies in many ranges.
    """
    role, text = whole_text("role"), whole_text("text")
    digest = F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256)
    words = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(word) for i, word in enumerate(_WORDS)]
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, _TIE_CHARS).alias("begin"), *words, F.char_length(text).cast("long").alias("chars")
    )
    order = ["conv_id", "turn", "role", "begin", *_WORDS, F.monotonically_increasing_id()]
    placed = in_ranges(turns, order, ["conv_id", *_WORDS, "chars"], range_rows, "turns")
    return durable(with_running(placed, {"pos": F.lit(1)}, ["conv_id"]), "numbered-turns")


def _fingerprinted(turns: DataFrame, bases: Sequence[int], primes: Sequence[int]) -> DataFrame:
    """Adds, for each prime, a turn's own term and the running fingerprint of its conversation up to it."""
    terms = [F.pmod(F.pmod(F.col(w), F.lit(p)) * _power(b, F.col("pos"), p), F.lit(p)).alias(f"t{i}") for i, (w, b, p) in enumerate(zip(_WORDS, bases, primes))]
    turns = turns.select("*", *terms)
    running = with_running(turns, {s: F.col(f"t{i}") for i, s in enumerate(_SUMS)}, ["conv_id"])
    return durable(running.withColumns({s: F.pmod(F.col(s), F.lit(p)) for s, p in zip(_SUMS, primes)}), "fingerprints")


def _packed(sums: Sequence[Column], prefix: str) -> list[Column]:
    """Three numbers below 2^31 as two."""
    return [(F.shiftleft(sums[0].cast("long"), 31) + sums[1]).alias(f"{prefix}a"), sums[2].cast("long").alias(f"{prefix}b")]


def _plans(turns: DataFrame, bases: Sequence[int], primes: Sequence[int]) -> DataFrame:
    """One row per conversation: how it is rebuilt, and the fingerprint of the whole.

    h own turns go; the first k of the base come instead, as `head`; `own` and `cut` are the fingerprints of all
    own turns and of the first h, `kept` that of the head.
    """
    h = head_length(F.col("conv_id"))
    early = F.when(F.col("pos") <= LONGEST_HEAD, F.struct("pos", *_SUMS, "t0", "t1", "t2", *_WORDS, "chars"))
    own = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(early)).alias("early"),  # at most LONGEST_HEAD
        *[F.pmod(F.sum(f"t{i}"), F.lit(p)).alias(f"own{i}") for i, p in enumerate(primes)],
        *[F.pmod(F.coalesce(F.sum(F.when(F.col("pos") <= h, F.col(f"t{i}"))), F.lit(0)), F.lit(p)).alias(f"cut{i}") for i, p in enumerate(primes)],
    )
    own = durable(own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK), "conversations")
    heads = own.select(F.col("conv_id").alias("base"), F.col("early").alias("_early"))
    # a base serves the ids of one block of a hundred
    plan = own.drop("early").join(heads, "base", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("_early", F.array().cast(heads.schema["_early"].dataType)), 1, F.col("h").cast("int"))).drop("_early")
    plan = plan.withColumn("k", F.size("head").cast("long"))
    kept = [F.when(F.col("k") > 0, F.element_at("head", F.greatest(F.col("k"), F.lit(1)).cast("int"))[s]).otherwise(0) for s in _SUMS]
    plan = plan.select("*", *[c.alias(f"kept{i}") for i, c in enumerate(kept)], (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return durable(plan, "plans")


def _rebuilt_sum(i: int, own: Column, bases: Sequence[int], primes: Sequence[int]) -> Column:
    """Fingerprint of the head followed by the own turns behind the first h, up to where `own` is taken."""
    tail = _shifted_back(F.pmod(own - F.col(f"cut{i}"), F.lit(primes[i])), F.col("h") - F.col("k"), bases[i], primes[i])
    return F.pmod(F.col(f"kept{i}") + tail, F.lit(primes[i]))


def _prefixes(turns: DataFrame, plans: DataFrame, bases: Sequence[int], primes: Sequence[int]) -> DataFrame:
    """One row per conversation and rebuilt turn: depth, fingerprints of prefix and parent, and the turn's reference."""
    three = range(len(primes))
    of_base = plans.select("conv_id", F.col("base").alias("ref_conv"), F.explode("head").alias("turn")).select(
        "conv_id", F.col("turn.pos").alias("depth"), *_packed([F.col(f"turn.{s}") for s in _SUMS], "f"),
        *_packed([F.pmod(F.col(f"turn.{s}") - F.col(f"turn.t{i}"), F.lit(primes[i])) for i, s in enumerate(_SUMS)], "p"),
        "ref_conv", F.col("turn.pos").alias("ref_pos"), *[f"turn.{w}" for w in _WORDS], "turn.chars",
    )
    later = turns.filter(F.col("pos") > head_length(F.col("conv_id")))
    # one row per conversation and range, so that no key of the join has more rows than a range
    wanted = plans.select("conv_id", "h", "k", *[f"{name}{i}" for name in ("kept", "cut") for i in three])
    wanted = turns.select("conv_id", PART).distinct().join(wanted, "conv_id")
    joined = later.join(wanted, ["conv_id", PART])
    of_own = joined.select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"),
        *_packed([_rebuilt_sum(i, F.col(s), bases, primes) for i, s in enumerate(_SUMS)], "f"),
        *_packed([_rebuilt_sum(i, F.col(s) - F.col(f"t{i}"), bases, primes) for i, s in enumerate(_SUMS)], "p"),
        F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), *_WORDS, "chars",
    )
    return of_base.unionByName(of_own)


def _nodes(turns: DataFrame, plans: DataFrame, bases: Sequence[int], primes: Sequence[int]) -> tuple[DataFrame, bool]:
    """Nodes by (depth, fingerprint), and whether every one holds equal prefixes only.

    Prefixes are equal if their last turns and, one level up, their parents are: a group is right when all its
    members refer to turns of one SHA-256 and have one parent.
    """
    proof = ("pa", "pb", *_WORDS)
    grouped = _prefixes(turns, plans, bases, primes).groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min("ref_conv").alias("ref_conv"), F.min_by("ref_pos", "ref_conv").alias("ref_pos"),
        *[F.min(name).alias(name) for name in proof], *[F.max(name).alias(f"{name}_max") for name in proof],
    )
    differs = F.lit(False)
    for name in proof:
        differs = differs | (F.col(name) != F.col(f"{name}_max"))
    grouped = durable(grouped.withColumn("_differs", differs).drop(*[f"{name}_max" for name in proof]), "prefix-groups")
    if not grouped.filter("_differs").isEmpty():
        return grouped, False
    none = F.lit(None).cast("long")
    root = plans.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"),
        none.alias("ref_conv"), none.alias("ref_pos"), none.alias("pa"), none.alias("pb"),
    )
    return grouped.select(*root.columns).unionByName(root), True


def _end_digests(plans: DataFrame, bases: Sequence[int], primes: Sequence[int]) -> DataFrame:
    """SHA-256 over the ids that end at a node; a task reads its nodes' ids in order and holds one digest at a time."""
    whole = [F.when(F.col("length") > F.col("k"), _rebuilt_sum(i, F.col(f"own{i}"), bases, primes)).otherwise(F.col(f"kept{i}")) for i in range(len(primes))]
    ends = plans.select("conv_id", F.col("length").alias("depth"), *_packed(whole, "f"))
    many = partitions_for(ends, F.lit(1), RANGE_ROWS)
    ordered = ends.repartition(many, *_NODE).sortWithinPartitions(*_NODE, "conv_id").select(*_NODE, "conv_id")
    return ordered.mapInArrow(_digests, "depth long, fa long, fb long, n_ends long, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["depth", "fa", "fb", "n_ends", "ends_sha256"]
    node, digest, seen = None, None, 0
    for batch in batches:
        done = []
        for *key, conv_id in zip(*[column.to_pylist() for column in batch.columns]):
            if key != node:
                if node:
                    done.append((*node, seen, digest.hexdigest()))
                node, digest, seen = key, hashlib.sha256(), 0
            digest.update(b",%d" % conv_id if seen else b"%d" % conv_id)
            seen += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*done)], names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([value]) for value in (*node, seen, digest.hexdigest())], names)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds n_children, and parent_conv_id: the smallest member of the parent.

    Members of a node are members of its parent, so the nodes whose smallest member is c are the lower part of c's
    path: but for the uppermost of them, a node's parent has the same smallest member.
    """
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, list(_NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = durable(nodes, "nodes")
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    upper = nodes.join(tops, ["conv_id", "depth"], "left_semi").filter("depth > 0")
    upper = upper.select("conv_id", "depth", F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).alias("_parent"))
    # a parent may have most of all nodes as children
    owners = nodes.filter("n_children > 0").select(F.struct(*_NODE).alias("_parent"), F.col("conv_id").alias("_owner"), "n_children")
    owned = attach_per_key(upper, owners, "_parent", "n_children").select("conv_id", "depth", "_owner")
    parent = F.when(F.col("depth") > 0, F.coalesce("_owner", "conv_id")).alias("parent_conv_id")
    return durable(nodes.join(owned, ["conv_id", "depth"], "left").select(*nodes.columns, parent), "parents")


_SUBTREE = ("leaves", "saved")


def _path_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, up, at, leaves, saved): sums over the subtree of each path's uppermost node, and where it hangs.

    Paths form a tree as well.  In round r every path passes its sums 2^r paths up, so the
    rounds are as many as the binary digits of the tree's height in paths, not of its depth in turns.
    """
    top = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"), *[F.sum(name).alias(name) for name in _SUBTREE])
    top = top.join(nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up")), ["conv_id", "depth"])
    paths = durable(top.select("conv_id", (F.col("depth") - 1).alias("at"), "up", F.col("up").alias("_to"), *_SUBTREE), "paths")
    while not paths.filter("_to IS NOT NULL").isEmpty():
        passed = paths.filter("_to IS NOT NULL").groupBy("_to").agg(*[F.sum(name).alias(f"_{name}") for name in _SUBTREE], F.count(F.lit(1)).alias("_rows"))
        passed = durable(passed, "passed")
        onward = passed.join(paths.select(F.col("conv_id").alias("_to"), F.col("_to").alias("_next")), "_to").select("_to", "_next", "_rows")
        moved = attach_per_key(paths.filter("_to IS NOT NULL").select("conv_id", "_to"), onward, "_to", "_rows").select("conv_id", "_next")
        summed = paths.drop("_to").join(passed.drop("_rows").withColumnRenamed("_to", "conv_id"), "conv_id", "left").join(moved, "conv_id", "left")
        sums = [(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in _SUBTREE]
        paths = durable(summed.select("conv_id", "at", "up", F.col("_next").alias("_to"), *sums), "paths")
    return paths.drop("_to")


def _with_subtrees(nodes: DataFrame, range_rows: int) -> DataFrame:
    """Adds n_leaves and saved_tokens: what hangs at a path's nodes, summed from the lower end of the path up."""
    own = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    hung = _path_totals(own).filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(name).alias(f"_{name}") for name in _SUBTREE])
    own = own.join(hung, ["conv_id", "depth"], "left")
    own = own.select(*nodes.columns, *[(F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in _SUBTREE])
    upward = in_ranges(own, ["conv_id", F.desc("depth")], own.columns, range_rows, "upward")
    return with_running(upward, {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, ["conv_id"]).drop(*_SUBTREE, PART, PLACE)


def prefix_trie(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Conversation c is rebuilt from the first h turns of conversation c - c % 100 (as many as it has) and its own turns behind
    its first h; h is crc32 of the decimal id modulo 6.  A node is a distinct sequence of (role, text), from the root without
    turns.  Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, n_ends and ends_sha256 (members that end there), ref_conv and ref_pos (a stored turn, numbered from 1, with
    the node's last role and text; null at the root).

    Turns are ordered by `turn`, null first; turns of one number by role, then by the first 64 code points of the text, then by
    the digest of the whole, so that repeated rows are turns of their own in a defined order.  Null role or text is empty.  Rows
    without an id belong to no conversation and are left out; other columns are not read.  No rows give no nodes.

    Groups by fingerprint (93 bits) are verified through the turns they refer to; if a group holds different prefixes
    all is done again with other bases.
    """
    turns = stored_turns(conversations, range_rows)
    for bases in BASES:
        fingerprints = _fingerprinted(turns, bases, PRIMES)
        plans = _plans(fingerprints, bases, PRIMES)
        nodes, right = _nodes(fingerprints, plans, bases, PRIMES)
        if right:
            break
    else:
        raise RuntimeError("no set of bases tells all prefixes apart")
    nodes = _with_subtrees(_with_parents(nodes), range_rows)
    nobody = hashlib.sha256(b"").hexdigest()
    nodes = nodes.join(_end_digests(plans, bases, PRIMES), list(_NODE), "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "ref_conv", "ref_pos",
    )
