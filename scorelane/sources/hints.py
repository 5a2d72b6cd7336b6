"""First-stage predictions and the catalogue of runs that made them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.text import read_result_name
from scorelane.schemas import CATALOGUE, HINT_MAP
from scorelane.session import path_exists


def read_hint_maps(
    spark: SparkSession,
    path: str,
    on_missing: str = "error",
    multi_line: bool = True,
    dataset: str | None = None,
    split: str | None = None,
    datasets: Sequence[str] = (),
    splits: Sequence[str] = (),
) -> DataFrame:
    """Prediction maps, one row per document.

    Maps made elsewhere do not say what they are of. ``dataset`` and ``split`` name
    it for all of them; else it is looked for in their file names, where ``datasets``
    and ``splits`` are the names that there may be.

    A missing or damaged map fails the job. With ``on_missing="empty"`` it is an
    empty one instead, with which responses get the default hint text.
    """
    if on_missing not in ("error", "empty"):
        raise ValueError(f"on_missing must be error or empty, not {on_missing!r}")
    if on_missing == "empty" and not path_exists(spark, path):
        return spark.createDataFrame([], HINT_MAP)
    mode = "FAILFAST" if on_missing == "error" else "PERMISSIVE"
    maps = spark.read.schema(HINT_MAP).json(path, multiLine=multi_line, mode=mode)
    named = {"dataset": F.lit(dataset), "split": F.lit(split)}
    if datasets and splits:
        found = read_result_name(F.col("_metadata.file_path"), datasets, splits)
        named = {name: F.coalesce(value, found[name]) for name, value in named.items()}
    kept = [F.coalesce(name, value).alias(name) for name, value in named.items()]
    return maps.select(*kept, *(name for name in HINT_MAP.names if name not in named))


def hint_rows(maps: DataFrame, *keep: str, place: str | None = None) -> DataFrame:
    """One row per prediction, keyed by ``sample_id``; ``place`` names a column for its place in the map.

    A map may repeat an id. Its entries all come out, and their place tells the last.
    """
    entries = maps.select(*keep, F.posexplode("binary_predictions").alias("_place", "key", "value"))
    placed = [] if place is None else [F.col("_place").alias(place)]
    return entries.select(
        *keep, F.col("key").try_cast("bigint").alias("sample_id"), F.col("value").alias("hint"), *placed
    )


def audio_column_mismatches(maps: DataFrame, audio_column: str) -> DataFrame:
    """Maps made from another audio column than the one in use."""
    return maps.where(F.col("audio_column") != audio_column)


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run catalogues: one row per dataset with its path, form, audio column and metrics.

    A foreign catalogue is one indented object. Ours has an object per line
    (``multi_line=False``).
    """
    entries = spark.read.text(path, wholetext=multi_line).select(
        F.explode(F.from_json("value", CATALOGUE, {"mode": "FAILFAST"})).alias("dataset", "entry")
    )
    return entries.select("dataset", "entry.*")
