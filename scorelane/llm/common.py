"""What the operators share: stages, row identity, and joins that bear hot keys."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import TypeVar

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import scorelane
from scorelane.session import work_path

# Our functions travel with the plan, so executors need not have this package.
register_pickle_by_value(scorelane)

#: Rows that a side may have to be broadcast, and the bytes of one of them that this allows for.
BROADCAST_ROWS = 500_000
#: A group is hot if it holds more than this part of all rows; so there are at most as many.
HOT_PART = 1000

ROW_KEY = "__scorelane_row"

Kept = TypeVar("Kept")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """``frame``, written to the shared folder and read back, which cuts its lineage."""
    spark = frame.sparkSession
    path = work_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def anchored(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` if they are read straight from files, else written and read back."""
    try:
        rows.select(rows.metadataColumn("_metadata")["row_index"])
        return rows
    except AnalysisException:
        return staged(rows, name)


def identified(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` with a column that names a row: its file and its place there.

    Such a name is the same whenever the row is read. Rows that do not come
    straight from files are written first.
    """
    rows = anchored(rows, name)
    place = rows.metadataColumn("_metadata")
    return rows.withColumn(ROW_KEY, F.xxhash64(place["file_path"], place["row_index"]))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to the one row of ``groups`` that has their ``key``.

    ``size`` counts the rows of a group. Groups with over a thousandth of all
    rows are at most a thousand, so they are broadcast, and their rows stay
    where they are. The rest are joined by a shuffle without a hot key. Both
    sides are read twice, so they ought to be stages.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(size) > F.lit(max(1, total // HOT_PART))
    large = F.broadcast(groups.where(hot))
    small = groups.where(~hot)
    among_large = rows.join(large, key)
    others = rows.join(F.broadcast(groups.where(hot).select(key)), key, "left_anti")
    return among_large.unionByName(others.join(small, key))


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Only for stages of a few narrow columns: they are counted first.
    """
    return F.broadcast(side) if side.count() <= rows else side


def select_rows(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the identified ``rows`` that the stage ``wanted`` names.

    There is one plan at every size: whole rows meet the wanted keys by a shuffle,
    unless Spark itself finds the keys few enough to broadcast.
    """
    return rows.join(wanted.select(ROW_KEY), ROW_KEY, "left_semi").select(*(quoted(c) for c in columns))


def kept_by_worker(key: object, make: Callable[[], Kept]) -> Kept:
    """What ``make`` gives, kept by this Python worker for its next tasks.

    Spark keeps workers, and functions that travel bring their own globals each
    time, so it lies in a module of the worker's. There is one such thing at a
    time: another operator's takes the place of the last, and frees its memory.
    """
    held = sys.modules.setdefault("scorelane_kept", ModuleType("scorelane_kept"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None
        held.value = make()
        held.key = key
    return held.value


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
