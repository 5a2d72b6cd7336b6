"""Row positions, and the first rows, batches and shards that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.session import few, work_path

#: A bucket's rows are numbered by one task with all their columns, so it spans a few thousand keys.
BUCKET_BITS = 12
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def with_position(
    rows: DataFrame,
    key: str,
    within: Sequence[str] = (),
    bucket_bits: int = BUCKET_BITS,
    ties: Sequence[str] = (),
    first: int | None = None,
) -> DataFrame:
    """Add ``position`` (0, 1, ... in the order of ``key``) and ``total`` per dataset.

    ``key`` is an integer without nulls, unique within its dataset or made so by
    ``ties``. Only rows before position ``first`` are kept, if it is given: buckets
    that start behind it go before anything is numbered. No dataset is ever sorted
    in one task: the key range is cut into buckets of at most
    ``2**bucket_bits`` keys, and the buckets into blocks of as many buckets.
    Rows are numbered inside their bucket, buckets are summed up inside their
    block, and only one row per block is brought together per dataset.

    Dataset and bucket form one struct, in which null equals null, so rows of a
    null dataset are numbered too. Numbering and join share its partitioning:
    the rows are shuffled once.
    """
    if dict(rows.dtypes)[key] not in INTEGERS:
        raise ValueError(f"rows are numbered by an integer key, and {key} is {dict(rows.dtypes)[key]}")
    bucket = F.shiftright(F.col(key), bucket_bits)
    block = F.shiftright(F.col("_bucket.bucket"), bucket_bits)
    buckets = (
        rows.select(F.struct(*within, bucket.alias("bucket")).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_set", F.struct(*[f"_bucket.{name}" for name in within], F.lit(0).alias("all")))
        .withColumn("_block", F.struct("_set", block.alias("block")))
    )
    blocks = buckets.groupBy("_block").agg(F.sum("_rows").alias("_block_rows"))

    def rows_before(count: str, group: str, order: str) -> Column:
        earlier = Window.partitionBy(group).orderBy(order)
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(count).over(earlier), F.lit(0))

    blocks = blocks.select(
        "_block",
        rows_before("_block_rows", "_block._set", "_block.block").alias("_block_start"),
        F.sum("_block_rows").over(Window.partitionBy("_block._set")).alias("total"),
    )
    in_block = rows_before("_rows", "_block", "_bucket.bucket")
    starts = buckets.join(blocks, "_block").select(
        "_bucket", (F.col("_block_start") + in_block).alias("_start"), "total"
    )
    own_bucket = Window.partitionBy("_bucket").orderBy(key, *ties)
    kept = rows.withColumn("_bucket", F.struct(*within, bucket.alias("bucket")))
    if first is not None:
        starts = starts.where(F.col("_start") < first)
        kept = kept.join(starts.select("_bucket"), "_bucket", "left_semi")
    numbered = kept.withColumn("_number", F.row_number().over(own_bucket) - 1)
    placed = numbered.join(starts, "_bucket").withColumn("position", F.col("_start") + F.col("_number"))
    if first is not None:
        placed = first_rows(placed, first)
    return placed.select(*rows.columns, "position", "total")


def ordered_position(rows: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` and ``total`` per dataset in the order of ``keys`` of any kind that Spark can sort.

    The rows are dealt by ranges of dataset and keys, which Spark takes from a sample, and
    written sorted, a range a file. A row's place in its file, less the place where its
    dataset begins there, plus the dataset's rows in earlier files, is its position: one
    row per dataset and file is all that meets. So no dataset is sorted in one task if the
    keys tell its rows apart; make them do so by adding an id, which also settles ties.
    Nulls come first, and a null dataset is one like others.
    """
    spark = rows.sparkSession
    path = work_path(spark, "ordered")
    marked = rows.withColumn("_set", F.struct(*within, F.lit(0).alias("all")))
    dealt = marked.repartitionByRange(*[F.col(name) for name in ("_set", *keys)])
    dealt.sortWithinPartitions("_set", *keys).write.option("maxRecordsPerFile", 0).parquet(path)
    kept = spark.read.schema(marked.schema).parquet(path)
    place = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    runs = place.groupBy("_set", "_file").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    # Files are numbered in the order of their ranges.
    earlier = Window.partitionBy("_set").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_set",
        "_file",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_set")).alias("total"),
    )
    numbered = place.join(few(starts, "ordered-starts"), ["_set", "_file"])
    return numbered.withColumn("position", F.col("_place") + F.col("_shift")).select(*rows.columns, "position", "total")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each dataset, by a position that is stored already."""
    return rows.where(F.col("position") < n)


def take_first(rows: DataFrame, key: str, n: int, within: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each dataset in the order of ``key``, with their position.

    There is one way for every ``n``: keys are counted by bucket, buckets that
    start behind the ``n``-th row are left out, and the rest is numbered.
    """
    return with_position(rows, key, within, first=n).drop("total")


def whole_part(dividend: Column, divisor: Column | int) -> Column:
    divisor = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", dividend, divisor)


def batch_number(position: Column, batch_size: int) -> Column:
    return whole_part(position, batch_size)


def drop_short_batch(rows: DataFrame, batch_size: int) -> DataFrame:
    """Leave out a last batch that is not full, as training does."""
    full = whole_part(F.col("total"), batch_size)
    return rows.where(batch_number(F.col("position"), batch_size) < full)


def shard_number(
    position: Column, shards: int, mode: str = "contiguous", total: Column | None = None
) -> Column:
    """The shard of a row. Both modes split the rows exactly.

    ``modulo`` deals rows out in turn. ``contiguous`` cuts the dataset into
    runs whose sizes differ by at most one, the longer ones first.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    if mode == "modulo":
        return position % shards
    if mode != "contiguous" or total is None:
        raise ValueError("mode must be modulo, or contiguous with a total")
    size = whole_part(total, shards)
    longer = total % shards
    in_longer = longer * (size + 1)
    # the divisor is never zero: with fewer rows than shards all lie in longer runs
    behind = longer + whole_part(position - in_longer, F.greatest(size, F.lit(1)))
    return F.when(position < in_longer, whole_part(position, size + 1)).otherwise(behind)
