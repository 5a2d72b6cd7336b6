"""Padded batches of token and audio arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.functions.arrays import attention_mask, length_mask, pad_frames, pad_ids
from scorelane.operators.position import batch_number, drop_short_batch


def with_batch_width(
    rows: DataFrame, values: str, batch_size: int, within: Sequence[str] = ()
) -> DataFrame:
    """Add ``batch``, ``width`` (the longest array in it) and ``batch_rows``.

    ``values`` are arrays, or their sizes where the arrays are not to be shuffled. A batch
    never holds more than ``batch_size`` rows, so neither does a window.
    """
    batch = Window.partitionBy(*within, "batch")
    size = F.size(values) if isinstance(rows.schema[values].dataType, T.ArrayType) else F.col(values)
    return rows.withColumn("batch", batch_number(F.col("position"), batch_size)).withColumns(
        {
            "width": F.max(size).over(batch),
            "batch_rows": F.count("*").over(batch),
        }
    )


def collate(
    rows: DataFrame,
    batch_size: int,
    within: Sequence[str] = (),
    drop_last: bool = False,
) -> DataFrame:
    """One record per batch from rows with ``position``, ``input_ids``, ``labels``, ``frames``.

    Ids and labels are padded on the left, audio frames behind. The audio mask
    is null for a batch of one row. Rows are shuffled once, unpadded; padding is
    done where the batch is, and a group holds at most ``batch_size`` rows.
    """
    if drop_last:
        rows = drop_short_batch(rows, batch_size)
    sample = F.struct("position", "sample_id", "input_ids", "labels", "frames")
    gathered = rows.groupBy(
        *within, batch_number(F.col("position"), batch_size).alias("batch")
    ).agg(F.sort_array(F.collect_list(sample)).alias("_rows"))

    def widest(field: str):
        return F.array_max(F.transform("_rows", lambda row: F.size(row[field])))

    frame_width = F.array_max(
        F.transform(
            "_rows",
            lambda row: F.coalesce(
                F.array_max(F.transform(row["frames"], lambda frame: F.size(frame))), F.lit(0)
            ),
        )
    )
    measured = gathered.withColumns(
        {
            "_ids": widest("input_ids"),
            "_labels": widest("labels"),
            "_frames": widest("frames"),
            "_frame": frame_width,
        }
    )
    padded = measured.select(
        *within,
        "batch",
        F.size("_rows").alias("batch_rows"),
        F.transform("_rows", lambda row: row["sample_id"]).alias("sample_ids"),
        F.transform("_rows", lambda row: pad_ids(row["input_ids"], F.col("_ids"))).alias(
            "input_ids"
        ),
        F.transform("_rows", lambda row: pad_ids(row["labels"], F.col("_labels"))).alias("labels"),
        F.transform(
            "_rows", lambda row: pad_frames(row["frames"], F.col("_frames"), F.col("_frame"))
        ).alias("input_audio"),
        F.transform("_rows", lambda row: F.size(row["frames"])).alias("audio_sizes"),
        F.when(
            F.size("_rows") > 1,
            F.transform("_rows", lambda row: length_mask(F.size(row["frames"]), F.col("_frames"))),
        ).alias("audio_mask"),
    )
    masks = F.transform("input_ids", lambda ids: attention_mask(ids))
    return padded.withColumn("attention_mask", masks)
