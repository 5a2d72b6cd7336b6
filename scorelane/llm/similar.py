"""Groups of documents that are alike by their word shingles, for the pipeline.

Fingerprints (``simhash``) find what differs in a few bits. Two documents with a
Jaccard similarity of 0.8 differ in ten bits of 64 as a rule, which no bucketing of
fingerprints finds. So the candidates are those of the fingerprints, and documents that
agree in a band of minima of their shingles' hashes; with 16 bands of five minima a
pair at 0.8 agrees in one with a chance of 0.998. Every candidate pair is verified by
the exact similarity of the two sets of shingles, so documents that are not alike never
meet in a group.

In a bucket of a band, members are held against one leader, never against each other:
in half of the bands the member with the smallest ``doc_id``, which is the original if
any is, else one that a hash picks, another in each band. Documents without a partner
are dealt once more, among themselves. So a group of copies of any size gives as many
pairs as it has members, times bands. A member that is like another member only, and
like no leader of its 16 buckets in two rounds, is missed.

Defined results: a null text is an empty one; empty texts are alike; a text of fewer
words than a shingle is one shingle; rows with a null ``doc_id`` take part and come
after all others; repeated rows and ties are told apart by their place; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import ROW_KEY, attach_groups, identified, staged, struct_of
from scorelane.llm.components import components
from scorelane.llm.simhash import BITS, BLOCKS, SEED, links, print_of, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
MINIMA = 5
#: Candidates whose minima agree in a smaller part than this are not verified: at a
#: similarity of 0.8 that is more than four standard deviations away.
LIKELY = 0.6
#: Shingles whose minima are taken at a time, and documents whose sets a task holds.
TAKEN = 1 << 12
SIGNED = 1 << 10

_SCHEMA = f"{ROW_KEY} bigint, doc_id bigint, print bigint, minima array<int>, shingles array<int>"


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest of the hashes under each of ``count`` fixed orders, as 32-bit numbers."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), TAKEN):
        least = np.minimum(least, (hashes[at : at + TAKEN, None] * factors[None, :]).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(documents: DataFrame, words: int = WORDS, count: int = BANDS * MINIMA) -> DataFrame:
    """A row per document: identity, ``doc_id``, fingerprint, minima, and its set of shingles as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SIGNED) for whole in batches for at in range(0, whole.num_rows, SIGNED)):
            prints, least, sets = [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py() or "", words)
                prints.append(print_of(hashes))
                distinct = np.unique(hashes)
                least.append(minima(distinct, count))
                sets.append(np.unique((distinct >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(least, pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int32()))],
                names=[ROW_KEY, "doc_id", "print", "minima", "shingles"],
            )

    rows = identified(documents.select("doc_id", "text"), "similar-input")
    return rows.select(ROW_KEY, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, struct_of(_SCHEMA))


def _buckets(signed: DataFrame, bands: int, size: int) -> DataFrame:
    """A row per document and band: the bucket it is in there."""
    parts = [
        F.xxhash64(F.lit(band), *(F.col("minima")[band * size + k] for k in range(size))) for band in range(bands)
    ]
    return signed.select(ROW_KEY, "doc_id", F.posexplode(F.array(*parts)).alias("band", "bucket"))


def _stars(buckets: DataFrame, first: Column, name: str) -> DataFrame:
    """Pairs (``a``, ``b``) of each member of a bucket and its leader, the one that comes ``first``."""
    led = buckets.groupBy("bucket").agg(F.min(first).alias("leader"), F.count(F.lit(1)).alias("members"))
    led = staged(led.where(F.col("members") > 1), f"{name}-leaders")
    met = attach_groups(buckets, led, "bucket", "members")
    return met.select(F.col(ROW_KEY).alias("a"), F.col(f"leader.{ROW_KEY}").alias("b")).where("a != b")


def _order(number: int) -> Column:
    """What makes a leader: the smallest id in bands of even number, else a hash of band and round."""
    by_id = F.col("band") % 2 == number % 2
    return F.struct(
        F.when(by_id, F.col("doc_id").isNull().cast("long")).otherwise(F.xxhash64(ROW_KEY, "band", F.lit(number))),
        F.when(by_id, F.col("doc_id")),
        F.col(ROW_KEY),
    )


def _alike(pairs: DataFrame, signed: DataFrame, similarity: float, name: str) -> DataFrame:
    """The ``pairs`` whose shingles are alike: minima first, and then the sets themselves."""
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

    def with_side(rows: DataFrame, side: str, value: str) -> DataFrame:
        sizes = rows.groupBy(side).agg(F.count(F.lit(1)).alias("pairs"))
        held = sizes.join(signed.select(F.col(ROW_KEY).alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return attach_groups(rows, staged(held, f"{name}-{value}-{side}"), side, "pairs").drop("pairs")

    def both(rows: DataFrame, value: str) -> DataFrame:
        return with_side(staged(with_side(rows, "a", value), f"{name}-{value}"), "b", value)

    agree = F.aggregate(
        F.zip_with("minima_a", "minima_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    likely = staged(
        both(pairs, "minima").where(agree >= LIKELY * F.size("minima_a")).select("a", "b"), f"{name}-likely"
    )
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    every = F.size("shingles_a") + F.size("shingles_b") - shared
    alike = F.when(every == 0, True).otherwise(shared >= similarity * every)
    return staged(both(likely, "shingles").where(alike).select("a", "b"), f"{name}-alike")


def similar_groups(
    documents: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rounds: int = 2,
    bits: int = BITS,
) -> DataFrame:
    """A row per document: identity, ``doc_id``, ``component_id`` and whether it stays.

    Of a component, the row with the smallest (``doc_id``, place) stays.
    """
    signed = staged(signatures(documents, words, bands * MINIMA), "signatures")
    by_print = signed.select(ROW_KEY, "doc_id", F.col("print").alias("bucket"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)
    leaders = staged(by_print.groupBy("bucket").agg(F.min(first)[ROW_KEY].alias("leader")), "print-leaders")
    near = staged(links(leaders.select(F.col("bucket").alias("print")), bits, BLOCKS), "print-links")
    a, b = (
        leaders.select(F.col("bucket").alias(side), F.col("leader").alias(f"{side}_row")) for side in ("a", "b")
    )
    pairs = near.join(a, "a").join(b, "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))
    pairs = pairs.unionByName(_stars(by_print, first, "prints"))
    buckets = staged(_buckets(signed, bands, MINIMA), "bands")
    verified = _alike(pairs.unionByName(_stars(buckets, _order(0), "bands-0")), signed, similarity, "round-0")
    for number in range(1, rounds):
        paired = verified.select(F.explode(F.array("a", "b")).alias(ROW_KEY)).distinct()
        alone = staged(buckets.join(paired, ROW_KEY, "left_anti"), f"alone-{number}")
        more = _alike(_stars(alone, _order(number), f"bands-{number}"), signed, similarity, f"round-{number}")
        verified = staged(verified.unionByName(more), f"verified-{number}")
    joined = staged(components(verified), "similar-classes")
    named = signed.select(ROW_KEY, "doc_id")
    rows = named.join(joined, named[ROW_KEY] == joined["node"], "left").select(
        ROW_KEY, "doc_id", F.coalesce("root", ROW_KEY).alias("root")
    )
    rows = staged(rows, "similar-rows")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias("first")
    groups = staged(rows.groupBy("root").agg(least, F.count(F.lit(1)).alias("copies")), "similar-groups")
    return attach_groups(rows, groups, "root", "copies").select(
        ROW_KEY,
        "doc_id",
        F.col("first.doc_id").alias("component_id"),
        (F.col(ROW_KEY) == F.col(f"first.{ROW_KEY}")).alias("kept"),
    )
