"""Result documents, in the current layout and the older parallel-array one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.schemas import RESULT_DOCUMENT


def read_result_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per document.

    Foreign documents are indented JSON. Our own are one line per slice of a
    run, which Spark can split (``multi_line=False``). A damaged document fails
    the job rather than counting as empty.
    """
    docs = spark.read.schema(RESULT_DOCUMENT).json(path, multiLine=multi_line, mode="FAILFAST")
    return docs.withColumn("document", F.col("_metadata.file_path"))


def result_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per sample: ``sample_id``, ``prediction``, ``label``.

    Reads ``predictions_and_labels``, else ``samples``. A document with neither
    has no rows; ``documents_without_samples`` lists them.
    """
    pairs = F.coalesce("predictions_and_labels", "samples")
    return documents.select(
        *keep, F.coalesce("first_id", F.lit(0)).alias("_first"), F.posexplode(pairs)
    ).select(
        *keep,
        (F.col("_first") + F.col("pos")).alias("sample_id"),
        F.col("col.prediction").alias("prediction"),
        F.col("col.label").alias("label"),
    )


def documents_without_samples(documents: DataFrame) -> DataFrame:
    return documents.where(F.coalesce("predictions_and_labels", "samples").isNull())


def parallel_array_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """The same rows from the older layout of two arrays side by side."""
    zipped = F.arrays_zip("all_generated_texts", "all_labels")
    return documents.select(
        *keep, F.coalesce("first_id", F.lit(0)).alias("_first"), F.posexplode(zipped)
    ).select(
        *keep,
        (F.col("_first") + F.col("pos")).alias("sample_id"),
        F.col("col.all_generated_texts").alias("prediction"),
        F.col("col.all_labels").alias("label"),
    )
