"""Whole jobs. The scorers are fixed rules, so that SQL can state what they answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators.metrics import metrics
from scorelane.operators.position import take_first, with_position
from scorelane.operators.prompts import supervised_examples
from scorelane.plans.conversion import convert_results
from scorelane.plans.evaluation import (
    Model,
    cascade,
    evaluate,
    evaluate_with_catalogue,
    ready,
    score,
    score_answers,
)
from scorelane.plans.export import export_samples, write_manifest
from scorelane.plans.stages import fingerprint, stage
from scorelane.session import is_complete, work_path
from scorelane.sinks.results import result_documents, write_documents
from scorelane.sources.hints import hint_rows, read_catalogue, read_hint_maps
from scorelane.suite import data, sql
from scorelane.suite.registry import query


def pass_fail_rule():
    """Answers with a pair: the pass mark of the signal, surer the larger its last digit."""

    def answer(batch: pd.DataFrame) -> list[str]:
        return [f"{int(tenths >= 40)},0.{60 + tenths % 10}" for tenths in batch["tenths"].tolist()]

    return answer


def guided_rule():
    """Answers with the signal, kept on the side of the hint that the prompt gives."""

    def answer(batch: pd.DataFrame) -> list[str]:
        hint = batch["prompt_text"].str.extract(r"First model: (\d),", expand=False)
        floor = hint.map({"1": 40}).fillna(0).astype(int)
        ceiling = hint.map({"0": 35}).fillna(50).astype(int)
        tenths = batch["tenths"].clip(lower=floor, upper=ceiling)
        return list((tenths // 10).astype(str) + "." + (tenths % 10).astype(str))

    return answer


def plain_rule():
    """Answers with the signal, and with words where it is lowest."""

    def answer(batch: pd.DataFrame) -> list[str]:
        asked = batch["tenths"].tolist()
        return [f"{tenths // 10}.{tenths % 10}" if tenths > 12 else "cannot tell" for tenths in asked]

    return answer


def low_rule():
    """Answers with 1.0 whatever it is asked."""
    return lambda batch: ["1.0"] * len(batch)


def marked_rule():
    """Answers like the plain rule, with a stop marker behind."""
    plain = plain_rule()
    return lambda batch: [text + "<|end|>" for text in plain(batch)]


def marked_pair_rule():
    """Answers like the pass/fail rule, with a digit too many and a stop marker."""
    plain = pass_fail_rule()
    return lambda batch: [f" {text}4<|end|>" for text in plain(batch)]


FIRST = Model("suite/pass-fail", pass_fail_rule, ("prompt_text", "tenths"), 1024)
SECOND = Model("suite/guided", guided_rule, ("prompt_text", "tenths"), 1024)
PLAIN = Model("suite/plain", plain_rule, ("prompt_text", "tenths"), 1024)
LOW = Model("suite/low", low_rule, ("prompt_text",), 1024)
MARKED_PAIRS = Model("suite/marked-pairs", marked_pair_rule, ("prompt_text", "tenths"), 1)
MARKED = Model("suite/marked", marked_rule, ("prompt_text", "tenths"), 1)

FIRST_SQL = """printf('%d,0.%d', CASE WHEN tenths >= 40 THEN 1 ELSE 0 END, 60 + tenths % 10)"""

PLAIN_ROWS = f"""{sql.RESPONSES}, answered AS (
  SELECT *, CASE WHEN tenths > 12 THEN {sql.TENTHS} ELSE 'cannot tell' END AS prediction,
    CAST(grade AS VARCHAR) AS label FROM responses
)"""


@query(f"WITH {PLAIN_ROWS} SELECT dataset, split, sample_id, prediction, label FROM answered")
def scored_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer run over every response, in batches."""
    return score(supervised_examples(data.responses(spark, folder)), PLAIN)


@query(
    f"""WITH {PLAIN_ROWS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS position FROM answered
)
SELECT dataset, sample_id, label, prediction FROM placed WHERE position < 10"""
)
def spot_check(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten responses of each dataset, asked one by one."""
    first = take_first(data.responses(spark, folder), "sample_id", 10, ["dataset"])
    examples = supervised_examples(first, variant="single")
    one_by_one = Model("suite/plain", plain_rule, ("prompt_text", "tenths"), 1)
    return score(examples, one_by_one).select("dataset", "sample_id", "label", "prediction")


@query(
    f"""WITH {PLAIN_ROWS}, parsed AS (
  SELECT *, {sql.score('prediction')} AS g, grade AS t FROM answered
)
SELECT dataset, split, {sql.SCORE_METRICS}, count(*) AS num_samples FROM parsed GROUP BY dataset, split"""
)
def evaluation_of_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """All datasets and splits scored, written, and measured in one plan."""
    path = work_path(spark, "evaluation")
    _, wide = evaluate(spark, data.responses(spark, folder), PLAIN, path)
    return wide


@query(
    f"""WITH {sql.RESPONSES}, pairs AS (
  SELECT *, {FIRST_SQL} AS prediction, {sql.pair_text('grade')} AS label FROM responses
), parsed AS (
  SELECT *, CAST(split_part(prediction, ',', 1) AS BIGINT) AS gl,
    CAST(split_part(prediction, ',', 2) AS DOUBLE) AS gp,
    CAST(split_part(label, ',', 1) AS BIGINT) AS tl, CAST(split_part(label, ',', 2) AS DOUBLE) AS tp
  FROM pairs
)
SELECT dataset, split, {sql.PAIR_METRICS}, count(*) AS num_samples FROM parsed GROUP BY dataset, split"""
)
def pair_evaluation_of_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """The pass/fail model over all datasets and splits."""
    path = work_path(spark, "evaluation")
    responses = data.responses(spark, folder)
    _, wide = evaluate(spark, responses, FIRST, path, target="pair", metric="binary")
    return wide.withColumns(
        {name: F.round(name, 9) for name in ("probability_mse", "combined_score")}
    )


GUIDED = f"""{sql.RESPONSES}, guided AS (
  SELECT *, CASE WHEN tenths >= 40 THEN tenths ELSE least(tenths, 35) END AS shown FROM responses
), parsed AS (SELECT *, shown / 10 AS g, grade AS t FROM guided)"""


@query(
    f"""WITH {GUIDED}
SELECT dataset, split, {sql.SCORE_METRICS}, count(*) AS num_samples FROM parsed GROUP BY dataset, split"""
)
def cascade_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Pass or fail first, then a score guided by it, and the score's metrics."""
    path = work_path(spark, "cascade")
    _, wide = cascade(spark, data.responses(spark, folder), FIRST, SECOND, path)
    return wide


@query(
    f"""WITH {GUIDED}
SELECT sample_id, (shown // 10) || '.' || (shown % 10) AS prediction, CAST(grade AS VARCHAR) AS label
FROM guided"""
)
def cascade_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """What the second model of the cascade answers."""
    path = work_path(spark, "cascade")
    rows, _ = cascade(spark, data.responses(spark, folder), FIRST, SECOND, path)
    return rows.select("sample_id", "prediction", "label")


@query(
    f"""WITH {sql.PARSED_SCORES}
SELECT dataset, {sql.SCORE_METRICS}, count(*) AS num_samples, true AS complete, true AS refused
FROM parsed GROUP BY dataset"""
)
def resumed_stage(spark: SparkSession, folder: str) -> DataFrame:
    """A complete stage of the same build is read again; another build at its place is refused."""
    path = work_path(spark, "stage")
    rows = data.score_results(spark, folder).select("dataset", "prediction", "label")
    own = {"model": "near", "rows": fingerprint(rows, rows.columns)}
    stage(spark, path, lambda: rows, ["dataset"], identity=own)
    again = stage(spark, path, lambda: rows, ["dataset"], identity=own)
    other = rows.withColumn("prediction", F.lit("built again"))
    changed = {"model": "near", "rows": fingerprint(other, other.columns)}
    try:
        stage(spark, path, lambda: other, ["dataset"], identity=changed)
        refused = False
    except ValueError:
        refused = True
    flags = {"complete": F.lit(is_complete(spark, path)), "refused": F.lit(refused)}
    return metrics(again, ["dataset"]).withColumns(flags)


@query(
    f"""WITH {PLAIN_ROWS}, both_models AS (
  SELECT 'suite/plain' AS model, dataset, split, grade AS t, {sql.score('prediction')} AS g FROM answered
  UNION ALL
  SELECT 'suite/low', dataset, split, grade, 1.0::DOUBLE FROM answered
)
SELECT model, dataset, split, {sql.SCORE_METRICS}, count(*) AS num_samples
FROM both_models GROUP BY model, dataset, split"""
)
def evaluation_of_two_models(spark: SparkSession, folder: str) -> DataFrame:
    """Two models under one root, one of them twice: each has its own results."""
    path = work_path(spark, "evaluation")
    responses = data.responses(spark, folder)
    found = []
    for model in (PLAIN, LOW, PLAIN):
        _, wide = evaluate(spark, responses, model, path)
        found.append(wide.withColumn("model", F.lit(model.name)))
    return found[1].unionByName(found[2])


def late_rule():
    """Answers like the plain rule, and says that it was asked in a later run."""
    plain = plain_rule()
    return lambda batch: [text + " (late)" for text in plain(batch)]


EARLY = Model("suite/dated", plain_rule, ("prompt_text", "tenths"), 1024, version="1")
LATE = Model("suite/dated", late_rule, ("prompt_text", "tenths"), 1024, version="1")


@query(
    f"""WITH {PLAIN_ROWS}
SELECT sample_id, dataset, split, label,
  CASE WHEN sample_id % 3 = 0 OR sample_id % 7 = 0 THEN prediction || ' (late)' ELSE prediction END AS prediction
FROM answered WHERE sample_id % 11 > 0"""
)
def resumed_by_part(spark: SparkSession, folder: str) -> DataFrame:
    """A run that meets more responses, changed ones and fewer: only the new and the changed are scored."""
    path = work_path(spark, "evaluation")
    number = F.col("sample_id")
    responses = data.responses(spark, folder)
    evaluate(spark, responses.where(number % 3 > 0), EARLY, path, parts=2)
    changed = F.when(number % 7 == 0, F.concat("prompt", F.lit(" Say why."))).otherwise(F.col("prompt"))
    later = responses.where(number % 11 > 0).withColumn("prompt", changed)
    rows, _ = evaluate(spark, later, LATE, path, grow=True, parts=3)
    return rows.select("sample_id", "dataset", "split", "label", "prediction")


@query(
    f"""WITH {sql.RESPONSES}, pairs AS (SELECT *, {FIRST_SQL} AS pair, {sql.pair_text('grade')} AS label FROM responses)
SELECT dataset, split, sample_id, label, ' ' || pair || '4<|end|>' AS prediction, pair AS answer FROM pairs"""
)
def single_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every response asked for a pair, cleaned of markers and brought to its usual form."""
    rows = ready(data.responses(spark, folder), None)
    examples = supervised_examples(rows, "pair", variant="single")
    return score_answers(examples, MARKED_PAIRS, target="pair")


@query(
    f"""WITH {PLAIN_ROWS}
SELECT dataset, split, sample_id, label, prediction || '<|end|>' AS prediction,
  prediction AS answer FROM answered"""
)
def all_single_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every response, answered, cleaned of markers and normalised."""
    rows = ready(data.responses(spark, folder), None)
    return score_answers(supervised_examples(rows, variant="single"), MARKED)


@query(
    f"""WITH {sql.RESPONSES}, parsed AS (
  SELECT *, CAST(tenths >= 40 AS INTEGER) = {sql.pair_label('grade')} AS same FROM responses
)
SELECT dataset, '1764' AS form_id, 'wav_path' AS audio_column, count(*) AS hints,
  'folder=' || regexp_replace(dataset, '[^A-Za-z0-9.-]', '_', 'g') || '_' || substr(md5(dataset), 1, 8)
    AS folder, avg(CAST(same AS INTEGER)) AS binary_accuracy
FROM parsed GROUP BY dataset"""
)
def catalogued_run(spark: SparkSession, folder: str) -> DataFrame:
    """A pass/fail run over all datasets: its catalogue, and the maps the catalogue names."""
    path = work_path(spark, "run")
    responses = data.responses(spark, folder)
    evaluate_with_catalogue(spark, responses, FIRST, path, F.lit("1764"), "wav_path", 1000)
    maps = read_hint_maps(spark, f"{path}/preds", multi_line=False)
    hints = hint_rows(maps, "dataset").groupBy("dataset").agg(F.count("*").alias("hints"))
    entries = read_catalogue(spark, f"{path}/catalogue", multi_line=False)
    return entries.join(hints, "dataset").select(
        "dataset",
        "form_id",
        "audio_column",
        "hints",
        F.substring_index("binary_preds_path", "/", -1).alias("folder"),
        F.col("accuracy_metrics")["binary_accuracy"].alias("binary_accuracy"),
    )


@query(
    f"""WITH {sql.PAIRS}, placed AS (
  SELECT dataset, prediction,
    row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS sample_id FROM pairs
)
SELECT dataset, sample_id, trim(prediction, {sql.SPACE}) AS hint, '1964' AS form_id
FROM placed WHERE contains(prediction, ',')"""
)
def converted_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result documents turned into prediction maps, as a reader of the maps finds them."""
    path = work_path(spark, "convert")
    rows = data.pair_results(spark, folder).select("dataset", "sample_id", "prediction", "label")
    placed = with_position(rows, "sample_id", ["dataset"]).withColumns(
        {"sample_id": F.col("position"), "split": F.lit("test")}
    )
    docs = result_documents(placed, 700, ["dataset", "split"])
    first = F.col("dataset") < "m"
    # two sets of documents, converted to one place
    for number, part in enumerate((docs.where(first), docs.where(~first))):
        write_documents(part, f"{path}/{number}/results_1964")
        convert_results(
            spark, f"{path}/{number}/results_1964", f"{path}/preds", "wav_path", 300, multi_line=False
        )
    maps = read_hint_maps(spark, f"{path}/preds", multi_line=False)
    return hint_rows(maps, "dataset", "form_id").select("dataset", "sample_id", "hint", "form_id")


@query(
    f"""WITH {sql.AUDIO}, asked AS (SELECT DISTINCT c_nationkey AS speaker_id FROM customer)
SELECT 'exported' AS outcome, sample_id AS id FROM audio_rows JOIN asked USING (speaker_id)
WHERE kind IN (0, 1, 3, 5, 6)
UNION ALL
SELECT 'skipped', sample_id FROM audio_rows JOIN asked USING (speaker_id) WHERE kind NOT IN (0, 1, 3, 5, 6)
UNION ALL
SELECT 'missing', CAST(speaker_id AS BIGINT) FROM asked
WHERE speaker_id NOT IN (SELECT speaker_id FROM audio_rows WHERE speaker_id IS NOT NULL)"""
)
def export_by_speaker(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of the speakers another table lists: exported, skipped, or nowhere to be found."""
    path = work_path(spark, "export")
    key = F.col("c_nationkey").cast("bigint")
    speakers = data.table(spark, folder, "customer").select(key.alias("speaker_id"))
    export = export_samples(
        data.audio_rows(spark, folder), speakers=speakers, audio_column="wav_path"
    )
    write_manifest(export.manifest, path)
    parts = [
        (spark.read.parquet(path), "exported", "sample_id"),
        (export.skipped, "skipped", "sample_id"),
        (export.missing, "missing", "speaker_id"),
    ]
    named = [
        part.select(F.lit(outcome).alias("outcome"), F.col(key).alias("id"))
        for part, outcome, key in parts
    ]
    return named[0].union(named[1]).union(named[2])
