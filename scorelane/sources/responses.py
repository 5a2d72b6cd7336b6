"""Graded response sets: one table partitioned by dataset, split and revision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.schemas import AUDIO, RESPONSES
from scorelane.session import few, same

PARTITIONS = ("dataset", "split", "revision")


def load_responses(
    spark: SparkSession,
    root: str,
    dataset: str,
    split: str,
    subset: str | None = None,
    revision: int | None = None,
    schema: T.StructType = RESPONSES,
) -> DataFrame:
    """One split of a response set. The filters prune folders, so only it is read."""
    rows = spark.read.schema(schema).parquet(root)
    rows = rows.where((F.col("dataset") == dataset) & (F.col("split") == split))
    if subset is not None:
        rows = rows.where(F.col("subset") == subset)
    if revision is not None:
        rows = rows.where(F.col("revision") == revision)
    return rows


#: Datasets whose revisions may be named in a filter.
NAMED_REVISIONS = 1000


def as_of_revision(
    rows: DataFrame, revision: int, by: Sequence[str] = ("dataset",), named: int = NAMED_REVISIONS
) -> DataFrame:
    """For each dataset, its newest revision that is not above ``revision``.

    The aggregate holds one row per dataset. Where there are at most ``named``, their
    revisions become a filter, so of a table in folders by dataset and revision only the
    chosen ones are listed and read. Where there are more, the aggregate, which is
    written first so that its size is known, is joined; the rows stay where they are. A
    null dataset is one like others.
    """
    rows = rows.where(F.col("revision") <= revision)
    current = few(rows.groupBy(*by).agg(F.max("revision").alias("revision")), "revisions")
    pairs = current.limit(named + 1).collect()
    if len(pairs) > named:
        return rows.join(current, same(rows, current, [*by, "revision"]), "left_semi")
    kinds = {field.name: field.dataType for field in current.schema.fields}
    chosen = [
        reduce(and_, (F.col(name).eqNullSafe(F.lit(pair[name]).cast(kinds[name])) for name in (*by, "revision")))
        for pair in pairs
    ]
    return rows.where(reduce(or_, chosen, F.lit(False)))


def checked_columns(rows: DataFrame, names: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """A row per dataset: its number of rows, whether it is empty, and the columns it lacks.

    A column that is null in all of a dataset's rows counts as lacking, as it is
    where datasets of different columns were united.
    """
    held = [name for name in names if name in rows.columns]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *(F.count(name).alias(f"_{name}") for name in held)
    )
    lacking = [F.when(F.col(f"_{n}") == 0, F.lit(n)) if n in held else F.lit(n) for n in names]
    return counts.select(
        *by,
        "rows",
        (F.col("rows") == 0).alias("empty"),
        F.array_join(F.array_compact(F.array(*lacking)), ",").alias("missing"),
    )


def require_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail before any job runs if a column is missing."""
    missing = [name for name in names if name not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {rows.columns}")
    return rows


def require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("the dataset has no rows")
    return rows


def optional_question(rows: DataFrame, column: str = "prompt") -> DataFrame:
    """The question column, empty where it is missing or null."""
    value = F.coalesce(F.col(column), F.lit("")) if column in rows.columns else F.lit("")
    return rows.withColumn(column, value)


def canonical_names(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename a dataset's own columns: ``names`` maps canonical name to own name."""
    return rows.withColumnsRenamed({own: canonical for canonical, own in names.items()})


def union_datasets(parts: Sequence[DataFrame]) -> DataFrame:
    """All datasets as one table; a column that one of them lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def audio_value(rows: DataFrame, column: str, fallback: str = "audio") -> Column:
    """The audio of a row: the first value with samples, else the first with a path.

    The chosen column comes before the fallback column. A column of paths becomes
    an audio value with a path and no samples.
    """

    def of(name: str) -> Column:
        if isinstance(rows.schema[name].dataType, T.StringType):
            empty = F.lit(None).cast(AUDIO)
            path = F.struct(
                F.lit(None).cast("array<float>").alias("array"),
                F.lit(None).cast("int").alias("sampling_rate"),
                F.col(name).alias("path"),
            )
            return F.when(F.col(name).isNotNull(), path).otherwise(empty)
        return F.col(name).cast(AUDIO)

    found = [of(name) for name in dict.fromkeys((column, fallback)) if name in rows.columns]
    if not found:
        return F.lit(None).cast(AUDIO)
    sampled = [F.when(has_samples(value), value) for value in found]
    placed = [F.when(value["path"].isNotNull(), value) for value in found]
    return F.coalesce(*sampled, *placed, *found)


def has_samples(audio: Column) -> Column:
    return audio["array"].isNotNull() & audio["sampling_rate"].isNotNull()


def audio_origin(audio: Column) -> Column:
    """Where the samples of an audio value come from."""
    return (
        F.when(audio.isNull(), "none")
        .when(has_samples(audio), "array")
        .when(audio["path"].isNotNull(), "path")
        .otherwise("none")
    )


def attach_audio_files(rows: DataFrame, audio: str, root: str) -> DataFrame:
    """Add the bytes of each row's audio file as ``content``; null where there is none.

    Paths in the audio column count from ``root``, whose folders are searched
    at any depth.
    """
    folder = urlparse(root).path.rstrip("/") + "/"
    files = rows.sparkSession.read.option("recursiveFileLookup", True).format("binaryFile")
    start = F.instr(F.col("path"), folder) + len(folder)
    listed = files.load(root).select(F.substr("path", start).alias("_file"), "content")
    return (
        rows.withColumn("_file", F.col(f"{audio}.path"))
        .join(listed, "_file", "left")
        .drop("_file")
    )
