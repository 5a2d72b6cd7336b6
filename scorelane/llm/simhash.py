"""SimHash near-dedup: pivot distance tables inside exact candidate buckets.

Two fingerprints that differ in at most four of 64 bits agree in at least two of
six blocks. So each distinct fingerprint goes to the 15 buckets of its pairs of
blocks, and no link is lost. Within a bucket a table of Hamming distances to
reference fingerprints is made: by the triangle inequality two fingerprints
link only if no coordinate differs by more than four. Survivors are verified.
A bucket is walked component by component, each fingerprint against those that
no component has yet, so a group of near copies needs no list of all its pairs.
A bucket of more than ``MOST`` fingerprints, as a large family of near copies makes,
is not walked but dealt once more by the same rule: what its members may differ in
are the bits outside their two blocks, and of six blocks of those two agree again.

Copies are one fingerprint, so they never meet as pairs.

Defined results: null texts are empty; a text without words has fingerprint
zero and links like any other; a text of fewer than four words has one shingle.
Rows with a null ``doc_id`` take part; a component's id is its smallest
``doc_id`` that is not null, or null. Repeated rows are given back as often, and of
equal ids the first by place stays. A very long text is read whole, its shingles
counted 32,768 at a time. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import ROW_KEY, attach_groups, identified, staged, struct_of
from scorelane.llm.components import components

WORDS = 4
BITS = 4
BLOCKS = 6
PIVOTS = 16
SEED = 42
#: Fingerprints that a task walks at once, and how often a larger bucket is dealt again;
#: three times leave its members 19 bits to differ in.
MOST = 20_000
DEALT = 3
#: Shingles whose bits are counted at a time, which bounds a task's memory.
COUNTED = 1 << 15

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = _WORD.findall(text.encode().translate(_LOWER))
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends[: len(parts) - words]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :], strict=True)),
        np.uint64,
        len(starts),
    )


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint, unsigned: bits that over half of the shingles' hashes have."""
    return print_of(shingle_hashes(text or "", words))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document: identity, ``doc_id`` and fingerprint (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text.as_py(), words)) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                names=[ROW_KEY, "doc_id", "print"],
            )

    rows = identified(documents.select("doc_id", "text"), "simhash-input")
    schema = struct_of(f"{ROW_KEY} bigint, doc_id bigint, print bigint")
    return rows.select(ROW_KEY, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pivots(count: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """Reference fingerprints; the same for the same seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64, endpoint=False)


def _masks(held: int, blocks: int, bits: int) -> list[int]:
    """``held`` and a mask of each choice of blocks of the other bits that ``bits`` differing ones must leave alone."""
    free = [bit for bit in range(64) if not held >> bit & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << bit for bit in free[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [held | sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def bucket_links(prints: np.ndarray, references: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links (member, root) that join what is linked among distinct ``prints``.

    Each fingerprint is held against those without a component yet: the distance
    table discards by its largest difference, the survivors are verified.
    """
    distance = np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)
    order = np.argsort(distance[:, 0], kind="stable")
    prints, distance = prints[order], distance[order]
    rest = np.ones(len(prints), bool)
    lead = distance[:, 0]
    low = np.searchsorted(lead, lead - bits, "left")
    high = np.searchsorted(lead, lead + bits, "right")
    for start in range(len(prints)):
        if not rest[start]:
            continue
        rest[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            near = np.flatnonzero(rest[low[at] : high[at]]) + low[at]
            for pivot in range(1, distance.shape[1]):
                if len(near) < 2:
                    break
                near = near[np.abs(distance[near, pivot] - distance[at, pivot]) <= bits]
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= bits]
            rest[near] = False
            for other in near.tolist():
                yield int(order[other]), int(order[start])
            frontier.extend(near.tolist())


def _walked(dealt: DataFrame, table: np.ndarray, bits: int, most: int | None) -> DataFrame:
    """Links ``a``-``b`` inside the buckets, and the fingerprints ``a`` with the ``part`` of buckets above ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        count, last = 0, None

        def rows(a: np.ndarray, b: np.ndarray | None, part: int | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            parts = none if part is None else pa.array(np.full(len(a), part, np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(a), none if b is None else pa.array(b), parts], names=["a", "b", "part"]
            )

        def done() -> Iterator[pa.RecordBatch]:
            """The last bucket's links, unless it was passed on."""
            if 1 < count and (most is None or count <= most):
                members = np.concatenate(kept)
                pairs = list(bucket_links(members.view(np.uint64), table, bits))
                if pairs:
                    index = np.array(pairs)
                    yield rows(members[index[:, 0]], members[index[:, 1]], None)

        for batch in batches:
            found = batch.column(0).to_numpy()
            part = batch.column(1).to_numpy()
            held = batch.column(2).to_numpy()
            if not len(found):
                continue
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (held[1:] != held[:-1])) + 1
            edges = [0, *cuts.tolist(), len(found)]
            for start, end in zip(edges, edges[1:], strict=False):
                key = (part[start], held[start])
                if key != last:
                    yield from done()
                    kept, count, last = [], 0, key
                kept.append(found[start:end].copy())
                count += end - start
                if most is not None and count > most:
                    yield rows(np.concatenate(kept), None, int(key[0]))
                    kept = []
        yield from done()

    return dealt.mapInArrow(run, struct_of("a bigint, b bigint, part bigint"))


def links(
    distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, references: int = PIVOTS, most: int = MOST
) -> DataFrame:
    """Links ``a``-``b`` between distinct fingerprints, enough to give their components.

    A bucket is one choice of blocks and their bits. Buckets are read in order
    from sorted partitions, so a task holds one bucket's fingerprints at a time, and
    passes on those of a bucket that is too large, to be dealt by more of their bits.
    """
    table = pivots(references)
    masks = _masks(0, blocks, bits)
    rows = distinct.select("print", F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("part", "mask"))
    found = []
    for turn in range(DEALT + 1):
        keyed = rows.select("print", F.col("part").cast("long"), F.col("print").bitwiseAND(F.col("mask")).alias("held"))
        dealt = keyed.repartition("part", "held").sortWithinPartitions("part", "held", "print")
        walked = staged(_walked(dealt, table, bits, most if turn < DEALT else None), f"links-{turn}")
        found.append(walked.where("part IS NULL").select("a", "b"))
        passed = walked.where("part IS NOT NULL")
        if turn == DEALT or passed.isEmpty():
            break
        # The masks of the choices that are in use, each with its own further choices.
        parts = sorted(row["part"] for row in passed.select("part").distinct().collect())
        finer = [(part, mask) for part in parts for mask in _masks(masks[part], blocks, bits)]
        again = distinct.sparkSession.createDataFrame(
            [(part, at, _signed(mask)) for at, (part, mask) in enumerate(finer)], "part long, next int, mask long"
        )
        masks = [mask for _, mask in finer]
        rows = passed.select(F.col("a").alias("print"), "part").join(F.broadcast(again), "part")
        rows = rows.select("print", F.col("next").alias("part"), "mask")
    every = found[0]
    for frame in found[1:]:
        every = every.unionByName(frame)
    return every.distinct()


def near_groups(documents: DataFrame, words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """A row per document: identity, ``doc_id``, ``fingerprint``, ``component_id`` and whether it stays.

    Of a component, the row with the smallest (``doc_id``, place) stays.
    """
    rows = staged(fingerprints(documents, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW_KEY))
    distinct = staged(
        rows.groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "prints"
    )
    joined = staged(components(staged(links(distinct, bits, blocks), "links")), "classes")
    classed = staged(
        distinct.join(joined, distinct["print"] == joined["node"], "left").select(
            "print", "first", "copies", F.coalesce("root", "print").alias("root")
        ),
        "classed",
    )
    # Partial sums make this safe for a class of any size.
    leaders = classed.groupBy("root").agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("prints"))
    groups = staged(
        attach_groups(classed.drop("first"), staged(leaders, "leaders"), "root", "prints").select(
            "print", "copies", "leader"
        ),
        "print-classes",
    )
    return attach_groups(rows, groups, "print", "copies").select(
        ROW_KEY,
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("leader.doc_id").alias("component_id"),
        (F.col(ROW_KEY) == F.col(f"leader.{ROW_KEY}")).alias("kept"),
    )
