"""Metrics, failures, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators.metrics import (
    adjusted_accuracy,
    compare_runs,
    merged_sums,
    metric_report,
    metric_sums,
    metrics,
    metrics_long,
    metrics_of_sums,
    parse_failures,
)
from scorelane.schemas import METRIC_NAMES
from scorelane.session import work_path
from scorelane.suite import data, sql
from scorelane.suite.registry import query


@query(
    f"""WITH {sql.PARSED_SCORES}
SELECT dataset, {sql.SCORE_METRICS}, count(*) AS num_samples FROM parsed GROUP BY dataset"""
)
def metrics_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return metrics(data.score_results(spark, folder), ["dataset"])


@query(
    f"""WITH {sql.PARSED_SCORES}
SELECT {sql.SCORE_METRICS}, count(*) AS num_samples FROM parsed"""
)
def metrics_overall(spark: SparkSession, folder: str) -> DataFrame:
    return metrics(data.score_results(spark, folder))


@query(
    f"""WITH {sql.PARSED_SCORES}
SELECT {sql.SCORE_METRICS}, count(*) AS num_samples FROM parsed"""
)
def merged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics over all rows from the stored sums of three sets, the third of which came later."""
    rows, path = data.score_results(spark, folder), work_path(spark, "sums")
    for part in range(3):
        metric_sums(rows.where(F.col("sample_id") % 3 == part), ["dataset", "split"]).write.mode("append").parquet(path)
    return metrics_of_sums(merged_sums(spark.read.parquet(path)))


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT dataset, count(*) FILTER (abs(g - t) <= 0.5) / count(*) AS accuracy, {sql.PAIR_METRICS},
  count(*) AS num_samples FROM parsed GROUP BY dataset"""
)
def merged_pair_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The same of pairs, per dataset, from sums per dataset and split."""
    rows, path = data.pair_results(spark, folder), work_path(spark, "sums")
    for part in range(2):
        own = rows.where(F.col("sample_id") % 2 == part)
        metric_sums(own, ["dataset", "split"], "pair").write.mode("append").parquet(path)
    wide = metrics_of_sums(merged_sums(spark.read.parquet(path), ["dataset"]), ["dataset"])
    return wide.withColumns({name: F.round(name, 9) for name in ("probability_mse", "combined_score")})


@query(
    f"""WITH {sql.PARSED_SCORES}, found AS (
  SELECT dataset, split, {sql.SCORE_METRICS} FROM parsed GROUP BY ALL
), n AS (SELECT dataset, split, count(*) AS num_samples FROM parsed GROUP BY ALL)
SELECT 'cl' AS metric, dataset, split, accuracy, absolute_accuracy,
  CAST(NULL AS DOUBLE) AS binary_accuracy, num_samples FROM found JOIN n USING (dataset, split)
UNION ALL
SELECT 'binary', dataset, split, NULL, NULL, binary_accuracy, num_samples
FROM found JOIN n USING (dataset, split)"""
)
def metrics_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Only the metrics that were asked for."""
    rows, by = data.score_results(spark, folder), ["dataset", "split"]
    chosen = [
        metrics(rows, by, metric=name).withColumn("metric", F.lit(name)) for name in ("cl", "binary")
    ]
    return chosen[0].unionByName(chosen[1], allowMissingColumns=True)


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT dataset, split, {sql.PAIR_METRICS}, count(*) AS num_samples FROM parsed GROUP BY dataset, split"""
)
def pair_metrics(spark: SparkSession, folder: str) -> DataFrame:
    wide = metrics(data.pair_results(spark, folder), ["dataset", "split"], "pair", "binary")
    return wide.withColumns(
        {name: F.round(name, 9) for name in ("probability_mse", "combined_score")}
    )


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT dataset, count(*) FILTER (abs(g - t) <= 0.5) / count(*) AS accuracy, {sql.PAIR_METRICS},
  count(*) AS num_samples FROM parsed GROUP BY dataset"""
)
def pair_and_score_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Pair answers under every metric; a pair is no plain score, so few are accurate."""
    wide = metrics(data.pair_results(spark, folder), ["dataset"], "pair", "both")
    return wide.withColumns(
        {name: F.round(name, 9) for name in ("probability_mse", "combined_score")}
    )


@query(
    f"""WITH {sql.RESPONSES}, rounded AS (
  SELECT dataset, {sql.half_down('(tenths / 10)')} = {sql.half_down('grade')} AS same FROM responses
)
SELECT dataset, count(*) FILTER (same) / count(*) AS adjusted_accuracy,
  count(*) FILTER (same) AS correct, count(*) AS num_samples
FROM rounded GROUP BY dataset"""
)
def adjusted_accuracy_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Strict rounding accuracy, on answers that all are plain scores."""
    rows = data.responses(spark, folder).withColumns(
        {
            "prediction": data.tenths_text(F.col("tenths")),
            "label": F.col("grade").cast("string"),
        }
    )
    return adjusted_accuracy(rows, ["dataset"])


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT dataset, count(*) FILTER (g IS NULL) AS no_score,
  count(*) FILTER (gl IS NULL OR gp IS NULL) AS no_pair,
  count(*) FILTER (NOT contains(prediction, ',')) AS no_comma,
  count(*) FILTER (t IS NULL) AS no_label_score, count(*) AS num_samples
FROM parsed GROUP BY dataset"""
)
def failures_by_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return parse_failures(data.pair_results(spark, folder), ["dataset"])


@query(
    f"""WITH {sql.PARSED_PAIRS}
SELECT dataset, {sql.PAIR_METRICS}, count(*) FILTER (g IS NULL) AS no_score,
  count(*) FILTER (gl IS NULL OR gp IS NULL) AS no_pair,
  count(*) FILTER (NOT contains(prediction, ',')) AS no_comma,
  count(*) FILTER (t IS NULL) AS no_label_score, count(*) AS num_samples
FROM parsed GROUP BY dataset"""
)
def metrics_with_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and failures from one scan, in which a text is parsed once for both."""
    wide = metrics(data.pair_results(spark, folder), ["dataset"], "pair", "binary", failures=True)
    return wide.withColumns({name: F.round(name, 9) for name in ("probability_mse", "combined_score")})


@query(
    f"""WITH {sql.PARSED_SCORES}, wide AS (
  SELECT dataset, {sql.SCORE_METRICS}, CAST(count(*) AS DOUBLE) AS num_samples
  FROM parsed GROUP BY dataset
)
SELECT dataset, metric, value, upper(metric) || ': ' || printf('%.4f', value) AS line
FROM (UNPIVOT wide ON accuracy, absolute_accuracy, binary_accuracy, num_samples
  INTO NAME metric VALUE value)"""
)
def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The report: a line per metric and dataset."""
    return metric_report(metrics(data.score_results(spark, folder), ["dataset"]), ["dataset"])


@query(
    f"""WITH {sql.PARSED_PAIRS}, wide AS (
  SELECT dataset, split, {sql.PAIR_METRICS} FROM parsed GROUP BY dataset, split
)
SELECT dataset, split, metric, round(value, 9) AS value
FROM (UNPIVOT wide ON binary_accuracy, probability_mse, probability_accuracy, combined_score
  INTO NAME metric VALUE value)"""
)
def metrics_in_long_form(spark: SparkSession, folder: str) -> DataFrame:
    """One row per metric; text columns and metrics that were not computed are left out."""
    wide = metrics(data.pair_results(spark, folder), ["dataset", "split"], "pair", "binary")
    wide = wide.drop("num_samples").withColumns(
        {"accuracy": F.lit(None).cast("double"), "note": F.lit("text")}
    )
    long = metrics_long(wide, ["dataset", "split"])
    return long.withColumn("value", F.round("value", 9))


@query(
    f"""WITH {sql.PARSED_SCORES}, runs AS (
  SELECT dataset, {sql.SCORE_METRICS} FROM parsed GROUP BY dataset
), exact AS (SELECT * REPLACE (tenths / 10 AS g) FROM parsed
), better AS (
  SELECT dataset, {sql.SCORE_METRICS} FROM exact GROUP BY dataset
), long AS (
  SELECT dataset, metric, value AS before FROM
    (UNPIVOT runs ON accuracy, absolute_accuracy, binary_accuracy INTO NAME metric VALUE value)
), long_better AS (
  SELECT dataset, metric, value AS after FROM
    (UNPIVOT better ON accuracy, absolute_accuracy, binary_accuracy INTO NAME metric VALUE value)
)
SELECT dataset, metric, before, after, after - before AS change
FROM long JOIN long_better USING (dataset, metric)"""
)
def before_and_after(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs on the same responses; the second answers with plain scores only."""
    before = data.score_results(spark, folder)
    after = before.withColumn("prediction", data.tenths_text(F.col("tenths")))
    by = ["dataset"]
    return compare_runs(metrics(before, by), metrics(after, by), by, METRIC_NAMES)
