"""Result tables and documents.

Tables are the form to work with. Documents hold ``slice_rows`` rows each,
numbered from their ``first_id``, the last one of a run fewer, so no task ever
holds a whole run. Every sink replaces the runs at hand and leaves others alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.operators.position import whole_part
from scorelane.session import few, same

RUN_KEYS = ("model", "dataset", "split")


def folder_name(name: Column) -> Column:
    """A name as a folder that needs no escaping and that no other name has."""
    text = F.coalesce(name.cast("string"), F.lit(""))
    plain = F.regexp_replace(text, r"[^A-Za-z0-9.-]", "_")
    return F.concat(plain, F.lit("_"), F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("\0"))), 1, 8))


def write_results(rows: DataFrame, path: str, by: Sequence[str] = RUN_KEYS) -> None:
    """Write rows in one folder per run, in id order inside a file.

    The rebalance hint lets Spark gather each run's rows into few files, and
    split a run that has most of the rows over many tasks. Runs that are written
    again are replaced, others stay.
    """
    order = [*by, "sample_id"] if "sample_id" in rows.columns else list(by)
    gathered = rows.hint("rebalance", *by).sortWithinPartitions(*order)
    (
        gathered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_bucketed(
    rows: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str]
) -> None:
    """Write rows as a table bucketed by key.

    Responses with audio are wide. Where they and their hints are bucketed
    alike, joining them moves neither side.
    """
    (
        rows.write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )


def write_metrics(wide: DataFrame, path: str, by: Sequence[str] = RUN_KEYS) -> None:
    """Replace the metrics of the runs at hand, and leave those of other runs alone."""
    (
        wide.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .json(path)
    )


def _slice(slice_rows: int) -> Column:
    return whole_part(F.col("sample_id"), slice_rows)


def result_documents(
    rows: DataFrame,
    slice_rows: int,
    by: Sequence[str] = RUN_KEYS,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Pairs of each run as documents, with the run's metrics on every slice.

    ``sample_id`` is the position in the run: 0, 1, 2 and so on, each once. Ids
    that are not so fail the job, whatever ``slice_rows`` is, as a document keeps
    positions only: use the tables. The first row of a slice also tells the slice
    before that it has to be full, so this needs no second look at the run.
    """
    pair = F.struct("sample_id", "prediction", "label")
    own = _slice(slice_rows)
    starts = (F.col("sample_id") % slice_rows == 0) & (F.col("sample_id") > 0)
    places = F.explode(F.when(starts, F.array(own, own - 1)).otherwise(F.array(own)))
    docs = (
        rows.select(*by, own.alias("_own"), pair.alias("_pair"), places.alias("_slice"))
        .groupBy(*by, "_slice")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_own") == F.col("_slice"), F.col("_pair")))).alias("_pairs"),
            F.max(F.col("_own") > F.col("_slice")).alias("_followed"),
        )
    )
    first = F.col("_slice") * slice_rows
    ids = F.transform("_pairs", lambda p: p["sample_id"])
    dense = ids == F.sequence(first, first + F.size("_pairs") - 1)
    whole = (F.size("_pairs") > 0) & (~F.col("_followed") | (F.size("_pairs") == slice_rows))
    gap = F.raise_error(F.lit("sample ids have gaps or repeat; number them with with_position first"))
    first_id = F.when(whole, F.when(dense, first).otherwise(gap.cast("bigint"))).otherwise(gap.cast("bigint"))
    pairs = F.transform("_pairs", lambda p: F.struct(p["prediction"], p["label"]))
    docs = docs.select(
        *by, first_id.alias("first_id"), pairs.alias("predictions_and_labels")
    )
    if metrics is None:
        return docs
    known = few(metrics, "run-metrics")
    return docs.join(known, same(docs, known, by)).drop(*(known[key] for key in by))


def write_documents(docs: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """One document per line, so that Spark can read a file of many in parallel.

    Documents lie in a folder per value of ``partitions``, else per run, which is
    what they say of model, dataset and split. Only the folders at hand are replaced.
    """
    if not partitions:
        named = [F.coalesce(key, F.lit("")) for key in RUN_KEYS if key in docs.columns]
        docs = docs.withColumn("run", folder_name(F.concat_ws("|", *named)))
    (
        docs.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*(partitions or ["run"]))
        .json(path)
    )


def hint_maps(
    hints: DataFrame,
    audio_column: str,
    slice_rows: int,
    form_id: Column | None = None,
    by: Sequence[str] = ("dataset", "split"),
) -> DataFrame:
    """Hints as prediction maps from sample id to text, in id order.

    Keys are ids, so gaps are no matter, and a map covers ``slice_rows`` ids.
    """
    entry = F.struct("sample_id", "hint")
    docs = hints.groupBy(*by, _slice(slice_rows).alias("_slice")).agg(
        F.sort_array(F.collect_list(entry)).alias("_hints")
    )
    entries = F.transform("_hints", lambda h: F.struct(h["sample_id"].cast("string"), h["hint"]))
    return docs.select(
        *by,
        F.map_from_entries(entries).alias("binary_predictions"),
        (form_id if form_id is not None else F.lit(None).cast("string")).alias("form_id"),
        F.lit(audio_column).alias("audio_column"),
    )


def catalogue_entries(
    metrics: DataFrame, preds_path: Column, form_id: Column, audio_column: Column
) -> DataFrame:
    """One catalogue row per dataset from its row of metrics."""
    names = [name for name, kind in metrics.dtypes if kind in ("double", "bigint")]
    values = F.map_from_arrays(
        F.array(*[F.lit(name) for name in names]),
        F.array(*[F.col(name).cast("double") for name in names]),
    )
    return metrics.select(
        "dataset",
        preds_path.alias("binary_preds_path"),
        form_id.alias("form_id"),
        audio_column.alias("audio_column"),
        F.map_filter(values, lambda _, value: value.isNotNull()).alias("accuracy_metrics"),
    )


def write_catalogue(entries: DataFrame, path: str) -> None:
    """One JSON object per dataset, in a folder of its own; entries of other datasets stay.

    The reader merges the lines into one table.
    """
    entry = F.struct("binary_preds_path", "form_id", "audio_column", "accuracy_metrics")
    line = F.to_json(F.create_map(F.col("dataset"), entry))
    (
        entries.select(line.alias("value"), folder_name(F.col("dataset")).alias("folder"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("folder")
        .text(path)
    )
