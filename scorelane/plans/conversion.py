"""From result documents to the prediction maps that the second stage reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.text import base_name, dataset_of, form_of, predictions_path
from scorelane.operators.hints import hints_from_results
from scorelane.sinks.results import hint_maps, write_documents
from scorelane.sources.results import read_result_documents, result_rows


def convert_results(
    spark: SparkSession,
    results: str,
    output: str,
    audio_column: str,
    slice_rows: int,
    strict: bool = True,
    multi_line: bool = True,
    names: Mapping[str, str] | None = None,
    default: str = "",
    split: str | None = None,
) -> DataFrame:
    """Write the maps of all result documents under ``results``; return their hints.

    A document's form follows from its path, and so does its dataset where it
    states none and ``names`` are given; ``split`` names the split of those that
    state none. Foreign documents number their samples alike, so each gets a folder
    of its own; of our documents each run does. Other files and runs that were
    converted to the same place stay. ``strict`` leaves out predictions without a comma.
    """
    docs = read_result_documents(spark, results, multi_line)
    path = F.col("document")
    if names is not None:
        found = dataset_of(base_name(path), names, default)
        docs = docs.withColumn("dataset", F.coalesce("dataset", found))
    if split is not None:
        docs = docs.withColumn("split", F.coalesce("split", F.lit(split)))
    hints = hints_from_results(result_rows(docs, "document", "dataset", "split"), strict)
    hints = hints.withColumns(
        {"form": form_of(path), "file": base_name(predictions_path(path))}
    )
    folders = ["file"] if multi_line else []
    run = [*folders, "dataset", "split"]
    maps = hint_maps(hints, audio_column, slice_rows, F.col("form"), [*run, "form"])
    write_documents(maps.drop("form"), output, folders)
    return hints.select(*run, "sample_id", "hint")
