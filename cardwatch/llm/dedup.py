"""Exact dedup through a cuckoo-filter index of text digests.

The index is cut into buckets by digest.  A bucket has a cuckoo filter (fingerprints, two slots
sets per digest) and its content: the live digests with the first row that has each and how
many rows do.  A digest that the filter has not seen is new; a hit is verified against the
content.  When an insert finds no place, the filter is built anew at twice the size from the
stored digests.  A generation of the index is written whole, so a lost executor costs nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.common import whole_text
from cardwatch.session import durable

SLOTS = 4
MOST_KICKS = 200
DIGESTS_PER_BUCKET = 10_000


class CuckooFilter:
    """Sixteen-bit fingerprints of 32-byte digests, four to a slot set; supports deletion."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def empty(cls, expected: int) -> "CuckooFilter":
        sets = 1 << max(2, (max(1, expected) * 10 // (9 * SLOTS)).bit_length())
        return cls(np.zeros((sets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return (place ^ (print_ * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        print_, first, second = self._places(digest)
        return print_ in self.table[first].tolist() or print_ in self.table[second].tolist()

    def add(self, digest: bytes) -> bool:
        """False when there is no place: the last fingerprint moved is then lost, build the filter anew."""
        print_, first, second = self._places(digest)
        for place in (first, second):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        place = second
        for kick in range(MOST_KICKS):
            slot = (kick * 7 + print_) % SLOTS
            print_, self.table[place, slot] = int(self.table[place, slot]), print_
            place = self._other(place, print_)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        return False

    def remove(self, digest: bytes) -> None:
        print_, first, second = self._places(digest)
        for place in (first, second):
            found = np.flatnonzero(self.table[place] == print_)
            if len(found):
                self.table[place, found[0]] = 0
                return


class Bucket:
    """One bucket: filter and content {digest: (first row's key, live rows)}."""

    def __init__(self, filter_data: bytes | None, content: dict[bytes, tuple]) -> None:
        self.content = content
        self.filter = CuckooFilter.load(filter_data) if filter_data else CuckooFilter.empty(len(content))
        self.resized = 0
        if not filter_data:
            self._rebuild(len(content))

    def _rebuild(self, expected: int) -> None:
        while True:
            self.filter = CuckooFilter.empty(expected)
            if all(map(self.filter.add, self.content)):
                return
            expected *= 2

    def insert(self, digest: bytes, first: tuple, rows: int) -> None:
        if digest in self.filter and digest in self.content:  # a filter hit alone may be another digest's
            kept, live = self.content[digest]
            self.content[digest] = (min(kept, first), live + rows)
            return
        self.content[digest] = (first, rows)
        if not self.filter.add(digest):
            self.resized += 1
            self._rebuild(2 * len(self.content))

    def delete(self, digest: bytes, rows: int) -> None:
        if digest not in self.filter or digest not in self.content:
            return
        first, live = self.content[digest]
        if live > rows:
            self.content[digest] = (first, live - rows)
        else:
            del self.content[digest]
            self.filter.remove(digest)


def text_digest(text: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text after each run of [\\x20\\x09-\\x0D] became one space."""
    # only runs that are not a single space already need a change
    runs = r"(?: (?=[ \t-\r])|[\t-\r])[ \t-\r]*"
    return F.sha2(F.encode(F.regexp_replace(whole_text(text), runs, " "), "utf-8"), 256)


INDEX = "bucket int, filter binary, digest binary, no_id boolean, id bigint, row bigint, live bigint"


class DigestIndex:
    """The index as a table: per bucket one row with the filter and one per live digest."""

    def __init__(self, spark, buckets: int) -> None:
        self.buckets = buckets
        self.rows = spark.createDataFrame([], INDEX)

    def _apply(self, changes: DataFrame) -> "DigestIndex":
        """`changes`: digest, no_id, id, row, rows (below 0: deletions), one row per digest."""
        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")
        changes = changes.select(bucket.alias("bucket"), "digest", "no_id", "id", "row", "rows")

        def change(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            filters = [x for x in left["filter"].to_pylist() if x is not None]
            stored = [r for r in left.select(["digest", "no_id", "id", "row", "live"]).to_pylist() if r["digest"] is not None]
            bucket = Bucket(filters[0] if filters else None, {r["digest"]: ((r["no_id"], r["id"], r["row"]), r["live"]) for r in stored})
            for r in right.to_pylist():
                if r["rows"] > 0:
                    bucket.insert(r["digest"], (r["no_id"], r["id"], r["row"]), r["rows"])
                else:
                    bucket.delete(r["digest"], -r["rows"])
            number = key[0].as_py()
            digests, values = list(bucket.content), list(bucket.content.values())
            return pa.table(
                {
                    "bucket": pa.array([number] * (1 + len(digests)), pa.int32()),
                    "filter": pa.array([bucket.filter.dump(), *[None] * len(digests)], pa.binary()),
                    "digest": pa.array([None, *digests], pa.binary()),
                    "no_id": pa.array([None, *(v[0][0] for v in values)], pa.bool_()),
                    "id": pa.array([None, *(v[0][1] for v in values)], pa.int64()),
                    "row": pa.array([None, *(v[0][2] for v in values)], pa.int64()),
                    "live": pa.array([None, *(v[1] for v in values)], pa.int64()),
                }
            )

        changed = self.rows.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(change, INDEX)
        self.rows = durable(changed, "digest-index")
        return self

    def insert(self, digests: DataFrame) -> "DigestIndex":
        """Adds rows (digest, id, row); of equal digests the smallest id, then row, stays. Counted per digest before the shuffle."""
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "row")).alias("first")
        return self._apply(digests.groupBy("digest").agg(first, F.count(F.lit(1)).alias("rows")).select("digest", "first.*", "rows"))

    def delete(self, digests: DataFrame) -> "DigestIndex":
        """Takes away one live row for each row of `digests` (column digest); unknown ones change nothing.

        What stays of a digest keeps its first row's key.
        """
        counts = digests.groupBy("digest").agg((-F.count(F.lit(1))).alias("rows"))
        return self._apply(counts.select("digest", F.lit(False).alias("no_id"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), "rows"))

    def content(self) -> DataFrame:
        live = self.rows.filter(F.col("digest").isNotNull())
        return live.select("digest", F.expr("if(no_id, null, id)").alias("keep_id"), F.col("row").alias("keep_row"), F.col("live").alias("group_size"))


# A digest with more than 1/HOT of the rows is joined by broadcast: there are fewer than HOT of them.
HOT = 1_000


def exact_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", batches: int = 2, per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when `text_digest` is; null is the empty text.  Of equal texts the row with the
    smallest id stays, null ids last; of repeated ids one row stays.  The rows go into a
    `DigestIndex` in `batches`, then each reads its digest's entry.  Other columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.unhex(text_digest(text)).alias("digest"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    index = DigestIndex(spark, max(1, -(-total // per_bucket)))
    for batch in range(batches):
        index.insert(rows.filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == batch))
    content = index.content()
    hot = F.broadcast(content.filter(F.col("group_size") > max(1, total // HOT)))
    cold = content.filter(F.col("group_size") <= max(1, total // HOT))
    joined = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
