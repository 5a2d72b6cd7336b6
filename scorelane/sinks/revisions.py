"""Bringing an old revision of a dataset back as its newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.session import few, path_exists, same


def restored_rows(rows: DataFrame, revision: int, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The rows of ``revision`` under the number after each dataset's newest.

    The newest revisions are written first: their size is known then, and old rows
    are not shuffled by the few datasets there are. A null dataset is one like others.
    """
    newest = few(rows.groupBy(*by).agg((F.max("revision") + 1).alias("_next")), "newest")
    old = rows.where(F.col("revision") == revision)
    joined = old.join(newest, same(old, newest, by)).drop(*(newest[key] for key in by))
    return joined.withColumn("revision", F.col("_next")).drop("_next").select(*rows.columns)


def restore_revision(
    rows: DataFrame, path: str, revision: int, partitions: Sequence[str]
) -> None:
    """Append the restored rows to the table at ``path`` as new partitions.

    They appear when the whole job commits, so one that was lost half-way
    leaves nothing behind and can run again.
    """
    if not path_exists(rows.sparkSession, path):
        raise ValueError(f"there is no table at {path}")
    (
        restored_rows(rows, revision)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )
