"""Exact dedup with a cuckoo-filter index over live digests.

The index is a table of entries (shard, digest, first copy, number of copies).
A task that changes or asks a shard loads it into a cuckoo filter: two candidate
buckets for a digest, a 16-bit print in each slot, and the stored digest beside
it. A print that matches is verified against the digest in its bucket, a filter
that overflows is made twice as large from the stored digests, and a digest
whose last copy goes is taken out of its slot.

Copies are counted by their own task first, with the same filter, so that a text
that fills a third of the table reaches its shard as a row per task.

Defined results: null texts count as empty; rows of one text with equal smallest
``doc_id`` are told apart by where they are stored, and one of them stays; null
``doc_id`` comes after all others; a text of any length is normalised and hashed inside
the JVM, and only its digest moves; an empty table gives an empty result. Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import ROW_KEY, attach_groups, identified, shards_for, staged, struct_of

SLOTS = 4
KICKS = 64
#: Distinct digests that a shard holds about; a task's memory follows from it.
SHARD_DIGESTS = 50_000
#: Distinct digests that a task gathers before it passes them on and starts anew.
TASK_DIGESTS = 200_000

ENTRY = "shard int, digest string, keep_null boolean, keep_id bigint, keep_row bigint, copies bigint"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; only runs that are not so already are touched."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "
    )


class CuckooIndex:
    """A cuckoo filter whose slots also hold the number of a stored entry."""

    def __init__(self, expected: int = 0):
        self.keys: list[bytes | None] = []
        self._clear(expected)

    def _clear(self, expected: int) -> None:
        buckets = 16
        while buckets * SLOTS * 0.85 < expected:
            buckets *= 2
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.entries = [0] * (buckets * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x9E3779B1 >> 7 & self.mask)

    def _slot(self, key: bytes) -> int:
        """The slot of ``key``, verified against the stored digest, or -1."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.entries[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The entry of ``key``, or -1."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.entries[slot]

    def insert(self, key: bytes) -> int:
        """The entry of ``key``, which is a new one if it was not live."""
        slot = self._slot(key)
        if slot >= 0:
            return self.entries[slot]
        self.keys.append(key)
        entry = len(self.keys) - 1
        if not self._place(entry):
            self._resize()
        return entry

    def delete(self, key: bytes) -> bool:
        """Take ``key`` out; whether it was there."""
        slot = self._slot(key)
        if slot < 0:
            return False
        self.keys[self.entries[slot]] = None
        self.prints[slot] = 0
        return True

    def _place(self, entry: int) -> bool:
        mark, bucket, other = self._places(self.keys[entry])
        for kick in range(KICKS):
            for place in (bucket, other):
                for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.entries[slot] = mark, entry
                        return True
            slot = other * SLOTS + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket, other = other, self._other(other, mark)
        return False

    def _resize(self) -> None:
        """Twice the buckets, or more, filled anew from the stored digests."""
        live = [i for i, key in enumerate(self.keys) if key is not None]
        size = (self.mask + 1) * SLOTS
        while True:
            self._clear(size)
            if all(self._place(entry) for entry in live):
                return
            size *= 2


class Copies:
    """Live digests with their first copy and their number of copies."""

    def __init__(self, expected: int = 0):
        self.index = CuckooIndex(expected)
        self.first: list[tuple] = []
        self.count: list[int] = []

    def add(self, digest: str, first: tuple, copies: int) -> None:
        entry = self.index.insert(bytes.fromhex(digest))
        if entry == len(self.first):
            self.first.append(first)
            self.count.append(copies)
        else:
            self.first[entry] = min(self.first[entry], first)
            self.count[entry] += copies

    def remove(self, digest: str, copies: int) -> None:
        key = bytes.fromhex(digest)
        entry = self.index.find(key)
        if entry >= 0:
            self.count[entry] -= copies
            if self.count[entry] <= 0:
                self.index.delete(key)

    def frame(self, shard_of) -> pd.DataFrame:
        live = [(key.hex(), *self.first[i], self.count[i]) for i, key in enumerate(self.index.keys) if key]
        return pd.DataFrame(
            [(shard_of(digest), digest, none, doc, row, copies) for digest, none, doc, row, copies in live],
            columns=["shard", "digest", "keep_null", "keep_id", "keep_row", "copies"],
        )


def digests(documents: DataFrame) -> DataFrame:
    """A row per document: its identity, ``doc_id`` and the digest of its normalised text."""
    rows = identified(documents.select("doc_id", "text"), "digest-input")
    return rows.select(
        ROW_KEY, "doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest")
    )


def _partials(shards: int, most: int):
    def shard_of(digest: str) -> int:
        return int(digest[-8:], 16) % shards

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        copies = Copies()
        for frame in frames:
            none = frame["doc_id"].isna()
            ids = frame["doc_id"].fillna(0).astype("int64")
            for digest, *first in zip(frame["digest"], none, ids, frame[ROW_KEY], strict=True):
                copies.add(digest, tuple(first), 1)
            if len(copies.first) >= most:
                yield copies.frame(shard_of)
                copies = Copies()
        yield copies.frame(shard_of)

    return run


def changes(rows: DataFrame, shards: int, task_digests: int = TASK_DIGESTS) -> DataFrame:
    """The copies of each task's digests, as entries to insert; a digest may have several."""
    return rows.mapInPandas(_partials(shards, task_digests), struct_of(ENTRY))


def update(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The index after ``inserts`` (entries), less ``deletes`` (shard, digest, copies).

    A digest leaves when no copy is left. The first copy that an entry names is
    the smallest that was ever inserted while the digest was live.
    """
    steps = inserts.withColumn("step", F.lit(1))
    if index is not None:
        steps = steps.unionByName(index.withColumn("step", F.lit(0)))
    if deletes is not None:
        gone = deletes.groupBy("shard", "digest").agg(F.sum("copies").alias("copies"))
        steps = steps.unionByName(gone.withColumn("step", F.lit(2)), allowMissingColumns=True)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        copies = Copies(len(frame))
        shard = int(frame["shard"].iloc[0])
        stored = frame[frame["step"] < 2].sort_values("step", kind="stable")
        for digest, none, doc, row, n in zip(
            stored["digest"], stored["keep_null"], stored["keep_id"], stored["keep_row"], stored["copies"],
            strict=True,
        ):
            copies.add(digest, (bool(none), int(doc), int(row)), int(n))
        gone = frame[frame["step"] == 2]
        for digest, n in zip(gone["digest"], gone["copies"], strict=True):
            copies.remove(digest, int(n))
        return copies.frame(lambda digest: shard)

    return steps.groupBy("shard").applyInPandas(run, struct_of(ENTRY))


def lookup(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``digest``) that the index holds, with their entry; both are stages."""
    return attach_groups(rows, index.drop("shard"), "digest", "copies")


def exact_groups(documents: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """A row per document with the copy that stays; see the module for ties and nulls."""
    rows = staged(digests(documents), "digests")
    shards = shards_for(rows.count(), shard_digests)
    index = staged(update(None, changes(rows, shards)), "cuckoo-index")
    found = lookup(index, rows)
    return found.select(
        ROW_KEY,
        "doc_id",
        F.when(~F.col("keep_null"), F.col("keep_id")).alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col(ROW_KEY) == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
