"""Mixing sources to target weights with hash-threshold histograms.

A source is to give ``target`` words. That is a number of whole copies of each of
its documents, and one more copy of the documents whose hash is below a
threshold; so the thresholds of the first and the second copy are nested. The
threshold comes from a histogram of words by source and hash bucket. Only the
bucket in which the budget ends is refined, by the next bits of the hash, until
one document is left; it is taken if that comes nearer the target. Documents are
then kept or dropped by comparing their hash. Nothing is sorted.

Defined results: null texts have no words; the null source is a source like any
other, the last in order; documents of one hash (repeated or null ``doc_id``) are
told apart by where they are stored; a source without words has target 0 and
gives no rows; words of a text of any length are counted inside the JVM, and no text
moves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelane.llm.common import ROW_KEY, anchored, attach_groups, bounded, identified, quoted, staged

#: Weights of sources in order, the share of all words, and the most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of a level of a histogram, and bits of a hash.
LEVEL_BITS = 12
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the text of ``key``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """Identified documents with their source's key, size and two hashes."""
    return identified(documents, "mixing-input").withColumns(
        {
            "__mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            "__mix_size": words(F.col("text")),
            "__mix_hash": _hash(F.col("doc_id")),
            "__mix_place": _hash(F.col(ROW_KEY)),
        }
    )


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number in code point order, null last, however many there are."""
    order = F.col("source").asc_nulls_last()
    parts = staged(
        sources.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select("*", F.monotonically_increasing_id().alias("i")),
        "sources",
    )
    part = F.shiftright("i", 33)
    starts = (
        parts.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    )
    return (
        parts.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .withColumn("number", F.col("start") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start", "i")
    )


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Sources (``source``, ``source_size``) with the words they are to give.

    The level at which words are dealt per weight rises as sources that would be
    above ``most`` copies stop there. A round is one row of sums.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    dealt = staged(_numbered(sources).withColumn("weight", weight), "weights")
    every = dealt.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (every["size"] or 0)
    level = budget / every["weight"] if every["weight"] else 0.0
    while True:
        stops = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        now = dealt.agg(
            F.coalesce(F.sum(F.when(stops, F.col("source_size") * most)), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if not now["weight"] or (budget - now["stopped"]) / now["weight"] == level:
            break
        level = (budget - now["stopped"]) / now["weight"]
    full = (F.col("source_size") * most).cast("double")
    return dealt.withColumn("target", F.least(full, F.lit(level) * F.col("weight"))).drop("number", "weight")


def _refine(rows: DataFrame, open_: DataFrame, value: str, shift: int) -> DataFrame:
    """The bucket of each open source in which its budget ends, and the words before it.

    ``open_`` has the prefix that is boundary so far. Buckets of a source are few,
    so their running sum is a small window.
    """
    bucket = F.shiftright(value, shift)
    held = rows.groupBy("__mix_source", bucket.alias("prefix")).agg(
        F.sum("__mix_size").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    running = Window.partitionBy("__mix_source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        held.join(bounded(open_.select("__mix_source", "before", "extra")), "__mix_source")
        .withColumn("until", F.col("before") + F.sum("words").over(running))
        .where("until > extra")
    )
    first = F.min(F.struct("prefix", (F.col("until") - F.col("words")).alias("before"), "words", "rows"))
    return (
        ends.groupBy("__mix_source", "extra")
        .agg(first.alias("end"))
        .select("__mix_source", "extra", "end.prefix", "end.before", "end.words", "end.rows")
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """Per source: copies of all its documents, and the bounds of one copy more.

    ``rows`` is a stage with ``__mix_source``, ``source``, ``__mix_size``, ``__mix_hash`` and ``__mix_place``.
    """
    sources = rows.groupBy("__mix_source", "source").agg(
        F.sum("__mix_size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    dealt = staged(targets(sources), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dealt = dealt.withColumn("whole", whole.cast("int")).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("source_size")
    )
    open_ = staged(
        dealt.where("extra > 0").select("__mix_source", "extra", F.lit(0).cast("long").alias("before")), "open"
    )
    left, done = rows, []
    for value in ("__mix_hash", "__mix_place"):
        for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
            open_ = staged(_refine(left, open_, value, shift), "open")
            ends = bounded(open_.select("__mix_source", F.col("prefix").alias("end")))
            left = staged(
                left.join(ends, "__mix_source").where(F.shiftright(value, shift) == F.col("end")).drop("end"),
                "boundary",
            )
        least = left.groupBy("__mix_source").agg(F.min("__mix_hash").alias("hash"), F.min("__mix_place").alias("place"))
        alone = F.col("rows") == 1
        closed = open_.where(alone if value == "__mix_hash" else F.lit(True)).join(least, "__mix_source")
        # The document in which the budget ends is taken if that comes nearer the target.
        near = F.col("before") + F.col("words") - F.col("extra") < F.col("extra") - F.col("before")
        last = F.lit(-1).cast("long") if value == "__mix_hash" else F.col("place") - 1
        done.append(closed.select("__mix_source", "hash", F.when(near, F.col("place")).otherwise(last).alias("place")))
        open_ = staged(open_.where(~alone), "open")
        if open_.isEmpty():
            break
    bounds = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    return staged(
        dealt.join(bounds, "__mix_source", "left").select(
            "__mix_source",
            "source_size",
            "target",
            "docs",
            "whole",
            "hash",
            "place",
            # Without a boundary the budget takes every document, or none if there is no budget.
            (F.col("extra") > 0).alias("more"),
        ),
        "thresholds",
    )


def copies(prefix: str = "") -> Column:
    """How often a document is taken, by its hashes and its source's thresholds."""
    bound = {name: F.col(prefix + name) for name in ("whole", "hash", "place", "more")}
    below = (F.col("__mix_hash") < bound["hash"]) | (
        (F.col("__mix_hash") == bound["hash"]) & (F.col("__mix_place") <= bound["place"])
    )
    return (bound["whole"] + F.when(F.coalesce(below, bound["more"]), 1).otherwise(0)).cast("int")


def _narrow(documents: DataFrame) -> DataFrame:
    rows = sized(documents.select("doc_id", "source", "text"))
    return staged(
        rows.select(ROW_KEY, "doc_id", "source", "__mix_source", "__mix_size", "__mix_hash", "__mix_place"), "sizes"
    )


def mix(documents: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``."""
    rows = _narrow(documents)
    found = attach_groups(rows, thresholds(rows), "__mix_source", "docs")
    return found.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("__mix_size") * copies()).alias("taken"),
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents of the mix, whole, each as often as the mix takes it."""
    documents = anchored(documents, "mixing-input")
    columns = documents.columns
    bounds = thresholds(_narrow(documents)).drop("source_size", "target", "docs")
    # Documents may have columns of any name.
    named = [F.col(c).alias(f"__mix_of_{c}") for c in bounds.columns if c != "__mix_source"]
    taken = sized(documents).join(bounded(bounds.select("__mix_source", *named)), "__mix_source")
    taken = taken.withColumn("__mix_copies", copies("__mix_of_"))
    # An array of nulls: it only says how many rows there are to be.
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies")))
    return taken.withColumn("__mix_copy", repeated).select(*(quoted(c) for c in columns))
