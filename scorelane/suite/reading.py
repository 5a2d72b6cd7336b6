"""Sources and sinks: what is written is read back and compared with where it came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.scores import decimal_text
from scorelane.functions.text import form_of
from scorelane.operators.hints import catalogue_lookup, hint_match_rate, hints_from_results
from scorelane.operators.metrics import metrics
from scorelane.operators.position import with_position
from scorelane.schemas import METRIC_NAMES
from scorelane.session import work_path
from scorelane.sinks.exports import export_manifest
from scorelane.sinks.files import write_named_texts
from scorelane.sinks.results import (
    catalogue_entries,
    hint_maps,
    result_documents,
    write_catalogue,
    write_documents,
    write_metrics,
    write_results,
)
from scorelane.sinks.revisions import restore_revision, restored_rows
from scorelane.sources.hints import (
    audio_column_mismatches,
    hint_rows,
    read_catalogue,
    read_hint_maps,
)
from scorelane.sources.indented import indented_hint_rows, indented_result_rows
from scorelane.sources.responses import (
    as_of_revision,
    attach_audio_files,
    audio_origin,
    audio_value,
    canonical_names,
    checked_columns,
    load_responses,
    optional_question,
    union_datasets,
)
from scorelane.sources.results import (
    documents_without_samples,
    parallel_array_rows,
    read_result_documents,
    result_rows,
)
from scorelane.suite import data, sql
from scorelane.suite.registry import query

MODEL = "org/near_model"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Score results numbered inside their dataset, as result documents need."""
    rows = data.score_results(spark, folder).select("dataset", "sample_id", "prediction", "label")
    return with_position(rows, "sample_id", ["dataset"]).select(
        F.lit("near_model").alias("model"),
        "dataset",
        F.lit("test").alias("split"),
        F.col("position").alias("sample_id"),
        "prediction",
        "label",
    )


def _some_unnamed(rows: DataFrame, column: str) -> DataFrame:
    """The rows, every fifth with a null in ``column``."""
    return rows.withColumn(column, F.when(F.col("sample_id") % 5 != 0, F.col(column)))


PLACED = f"""WITH {sql.SCORES}, placed AS (
  SELECT dataset, prediction, label,
    row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS sample_id FROM scores
)"""


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, speaker_id, grade, prompt FROM responses
WHERE dataset = 'click' AND split = 'train' AND revision = 1"""
)
def load_revision(spark: SparkSession, folder: str) -> DataFrame:
    """One dataset, split and revision of a partitioned table: only its folder is read."""
    path = work_path(spark, "responses")
    rows = data.responses(spark, folder)
    write_results(rows, path, ["dataset", "split", "revision"])
    chosen = load_responses(spark, path, "click", "train", revision=1, schema=rows.schema)
    return chosen.select("sample_id", "speaker_id", "grade", "prompt")


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, revision, grade, prompt FROM responses
WHERE dataset = 'signup' AND split = 'dev'"""
)
def load_split(spark: SparkSession, folder: str) -> DataFrame:
    """A split with all its revisions."""
    path = work_path(spark, "responses")
    rows = data.responses(spark, folder)
    write_results(rows, path, ["dataset", "split", "revision"])
    chosen = load_responses(spark, path, "signup", "dev", schema=rows.schema)
    return chosen.select("sample_id", "revision", "grade", "prompt")


@query(
    f"""WITH {sql.RESPONSES}, named AS (
  SELECT * REPLACE (CASE WHEN sample_id % 5 <> 0 THEN prompt END AS prompt) FROM responses
), newest AS (
  SELECT prompt AS topic, max(revision) AS newest FROM named WHERE revision <= 2 GROUP BY prompt
)
SELECT sample_id, prompt, revision, grade FROM named JOIN newest
  ON prompt IS NOT DISTINCT FROM topic AND revision = newest"""
)
def as_of_revision_2(spark: SparkSession, folder: str) -> DataFrame:
    """For each topic, its newest revision up to 2."""
    rows = data.responses(spark, folder)
    return as_of_revision(_some_unnamed(rows, "prompt"), 2, ["prompt"]).select("sample_id", "prompt", "revision", "grade")


@query(
    f"""WITH {sql.RESPONSES}, newest AS (
  SELECT dataset, max(revision) + 1 AS next FROM responses GROUP BY dataset
)
SELECT sample_id, dataset, revision, grade FROM responses
UNION ALL
SELECT sample_id, dataset, next AS revision, grade FROM responses JOIN newest USING (dataset)
WHERE revision = 1"""
)
def restore_old_revision(spark: SparkSession, folder: str) -> DataFrame:
    """A table after revision 1 was appended to it as its newest."""
    path = work_path(spark, "responses")
    rows = data.responses(spark, folder).select("sample_id", "dataset", "revision", "grade")
    write_results(rows, path, ["dataset", "revision"])
    table = spark.read.schema(rows.schema).parquet(path)
    restore_revision(table, path, 1, ["dataset", "revision"])
    return spark.read.schema(rows.schema).parquet(path)


@query(
    f"""WITH {sql.RESPONSES}, named AS (
  SELECT * REPLACE (CASE WHEN sample_id % 5 <> 0 THEN dataset END AS dataset) FROM responses
), newest AS (
  SELECT dataset, max(revision) + 1 AS next FROM named GROUP BY dataset
)
SELECT sample_id, named.dataset, next AS revision FROM named JOIN newest
  ON named.dataset IS NOT DISTINCT FROM newest.dataset WHERE revision = 3"""
)
def rows_of_restored_revision(spark: SparkSession, folder: str) -> DataFrame:
    """What restoring revision 3 would append."""
    rows = _some_unnamed(data.responses(spark, folder), "dataset")
    return restored_rows(rows, 3).select("sample_id", "dataset", "revision")


@query(f"{PLACED} SELECT dataset, sample_id, prediction, label FROM placed")
def result_documents_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under either of the two keys, written, read and taken apart again."""
    path = work_path(spark, "documents")
    docs = result_documents(_placed(spark, folder), 500)
    other_key = F.col("dataset") == "click"
    pairs = F.col("predictions_and_labels")
    write_documents(
        docs.withColumns(
            {
                "samples": F.when(other_key, pairs),
                "predictions_and_labels": F.when(~other_key, pairs),
            }
        ),
        path,
    )
    return result_rows(read_result_documents(spark, path, multi_line=False), "dataset")


@query(f"{PLACED} SELECT dataset, sample_id, prediction, label FROM placed")
def parallel_arrays_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The older layout of two arrays side by side."""
    path = work_path(spark, "documents")
    pairs = F.col("predictions_and_labels")
    docs = result_documents(_placed(spark, folder), 500)
    write_documents(
        docs.select(
            "dataset",
            "first_id",
            F.transform(pairs, lambda p: p["prediction"]).alias("all_generated_texts"),
            F.transform(pairs, lambda p: p["label"]).alias("all_labels"),
        ),
        path,
    )
    return parallel_array_rows(read_result_documents(spark, path, multi_line=False), "dataset")


@query(
    f"""{PLACED}
SELECT dataset, sample_id // 500 * 500 AS first_id, count(*) AS pairs,
  CAST(NULL AS BIGINT) AS without_samples FROM placed GROUP BY ALL
UNION ALL
SELECT dataset, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), count(DISTINCT sample_id // 500)
FROM placed WHERE dataset = 'view' GROUP BY dataset"""
)
def result_document_slices(spark: SparkSession, folder: str) -> DataFrame:
    """How a run is cut into documents, and which documents have no samples."""
    docs = result_documents(_placed(spark, folder), 500)
    sizes = docs.select("dataset", "first_id", F.size("predictions_and_labels").cast("bigint"))
    bare = docs.withColumn(
        "predictions_and_labels",
        F.when(F.col("dataset") != "view", F.col("predictions_and_labels")),
    ).withColumn("samples", F.lit(None).cast("array<struct<prediction:string,label:string>>"))
    lacking = documents_without_samples(bare).groupBy("dataset").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("bigint")
    return sizes.toDF("dataset", "first_id", "pairs").withColumn("without_samples", none).union(
        lacking.select("dataset", none, none, "n")
    )


@query(
    f"""WITH {sql.SCORES}
SELECT 'near_model' AS model, dataset, split, sample_id, prediction, label FROM scores
UNION ALL
SELECT 'label_model', dataset, split, sample_id, label, label FROM scores"""
)
def results_table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Results of two models, written one after the other in a folder per model, dataset and split."""
    path = work_path(spark, "results")
    columns = ["dataset", "split", "sample_id", "prediction", "label"]
    rows = data.score_results(spark, folder).select(F.lit("near_model").alias("model"), *columns)
    write_results(rows, path)
    write_results(rows.withColumns({"model": F.lit("label_model"), "prediction": F.col("label")}), path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"WITH {sql.HINTS} SELECT dataset, split, sample_id, hint FROM hints")
def prediction_maps_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Usable predictions as maps from id to text, and as rows again."""
    path = work_path(spark, "hints")
    hints = hints_from_results(data.pair_results(spark, folder))
    write_documents(hint_maps(hints, "wav_path", 1000), path)
    maps = read_hint_maps(spark, path, multi_line=False)
    return hint_rows(maps, "dataset", "split")


@query(
    f"""WITH {sql.HINTS}
SELECT dataset, split, sample_id // 1000 AS slice, count(*) AS hints,
  string_agg(sample_id || '=' || hint, ';' ORDER BY sample_id) AS entries,
  '1764' AS form_id, 'wav_file' AS audio_column
FROM hints WHERE split = 'dev' GROUP BY ALL"""
)
def prediction_maps_of_other_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Maps that were made from another audio column than the one in use."""
    hints = hints_from_results(data.pair_results(spark, folder))
    form = form_of(F.col("dataset"))
    dev = hint_maps(hints.where("split = 'dev'"), "wav_file", 1000, form)
    train = hint_maps(hints.where("split = 'train'"), "wav_path", 1000, form)
    other = audio_column_mismatches(union_datasets([dev, train]), "wav_path")
    entries = F.map_entries("binary_predictions")
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    first = F.element_at(entries, 1)["key"].cast("bigint")
    return other.select(
        "dataset",
        "split",
        F.floor(first / 1000).alias("slice"),
        F.size(entries).cast("bigint").alias("hints"),
        F.array_join(shown, ";").alias("entries"),
        "form_id",
        "audio_column",
    )


@query(
    f"""WITH {sql.PARSED_PAIRS}, wide AS (
  SELECT dataset, {sql.PAIR_METRICS}, CAST(count(*) AS DOUBLE) AS num_samples
  FROM parsed GROUP BY dataset
)
SELECT dataset, 'eval/binary_preds_' || dataset || '.json' AS binary_preds_path,
  CASE WHEN dataset LIKE '%1964%' THEN '1964' ELSE '1764' END AS form_id,
  'wav_path' AS audio_column, metric, round(value, 9) AS value
FROM (UNPIVOT wide ON binary_accuracy, probability_mse, probability_accuracy, combined_score,
  num_samples INTO NAME metric VALUE value)"""
)
def run_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of a pair run over all datasets, written, read and looked up."""
    path = work_path(spark, "catalogue")
    wide = metrics(data.pair_results(spark, folder), ["dataset"], mode="pair", metric="binary")
    preds = F.concat(F.lit("eval/binary_preds_"), F.col("dataset"), F.lit(".json"))
    form = form_of(preds)
    entries = catalogue_entries(wide, preds, form, F.lit("wav_path"))
    first = F.col("dataset") < "m"
    write_catalogue(entries.where(first), path)
    write_catalogue(entries.where(~first), path)
    return read_catalogue(spark, path, multi_line=False).select(
        "dataset",
        "binary_preds_path",
        "form_id",
        "audio_column",
        F.explode("accuracy_metrics").alias("metric", "value"),
    ).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {sql.RESPONSES}
SELECT dataset, count(*) AS responses,
  'eval/binary_preds_' || dataset || '.json' AS binary_preds_path, 'wav_path' AS audio_column
FROM responses GROUP BY dataset"""
)
def catalogue_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each dataset's rows with the path its run is catalogued under."""
    rows = data.responses(spark, folder)
    entries = rows.select("dataset").distinct().select(
        "dataset",
        F.concat(F.lit("eval/binary_preds_"), F.col("dataset"), F.lit(".json")).alias(
            "binary_preds_path"
        ),
        F.lit("1764").alias("form_id"),
        F.lit("wav_path").alias("audio_column"),
    )
    return (
        catalogue_lookup(rows.select("dataset", "sample_id"), entries)
        .groupBy("dataset", "binary_preds_path", "audio_column")
        .agg(F.count("*").alias("responses"))
    )


@query(
    f"""WITH {sql.PARSED_SCORES}
SELECT 'near_model' AS model, dataset, split, {sql.SCORE_METRICS}, count(*) AS num_samples
FROM parsed GROUP BY dataset, split"""
)
def metrics_table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of a run, written twice: the second time replaces its own rows only."""
    path = work_path(spark, "metrics")
    rows = data.score_results(spark, folder).withColumn("model", F.lit("near_model"))
    wide = metrics(rows, ["model", "dataset", "split"])
    write_metrics(wide.withColumn("accuracy", F.lit(-1.0)), path)
    write_metrics(wide, path)
    return spark.read.schema(wide.schema).json(path)


@query(
    f"""WITH {sql.RESPONSES}
SELECT dataset, sample_id, 'a/' || sample_id AS audio, prompt, prompt AS note
FROM responses WHERE dataset IN ('click', 'view')
UNION ALL
SELECT dataset, sample_id, 'b/' || sample_id AS audio, '' AS prompt, NULL AS note
FROM responses WHERE dataset NOT IN ('click', 'view')"""
)
def renamed_union(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets that name their audio differently, and one without questions, as one table."""
    rows = data.responses(spark, folder)
    first = F.col("dataset").isin("click", "view")
    some = rows.where(first).select(
        "dataset",
        "sample_id",
        F.concat(F.lit("a/"), F.col("sample_id")).alias("wav_path"),
        "prompt",
        F.col("prompt").alias("note"),
    )
    others = rows.where(~first).select(
        "dataset", "sample_id", F.concat(F.lit("b/"), F.col("sample_id")).alias("wav_file")
    )
    return union_datasets(
        [
            canonical_names(some, {"audio": "wav_path"}),
            optional_question(canonical_names(others, {"audio": "wav_file"})),
        ]
    )


@query(
    f"""WITH {sql.RESPONSES}, config AS (
  SELECT * FROM (VALUES ('click', '1764', 'wav_path'), ('signup', '1964', 'wav_file'))
    AS c(dataset, form_id, audio_column)
)
SELECT dataset, form_id, audio_column, count(*) AS responses, avg(grade) AS mean_grade
FROM responses JOIN config USING (dataset) GROUP BY ALL"""
)
def work_list(spark: SparkSession, folder: str) -> DataFrame:
    """The datasets a job is configured for, each with its form and audio column."""
    config = spark.createDataFrame(
        [("click", "1764", "wav_path"), ("signup", "1964", "wav_file")],
        "dataset string, form_id string, audio_column string",
    )
    return (
        data.responses(spark, folder)
        .join(config, "dataset")
        .groupBy("dataset", "form_id", "audio_column")
        .agg(F.count("*").alias("responses"), F.avg("grade").alias("mean_grade"))
    )


@query(
    f"""WITH {sql.AUDIO}
SELECT sample_id,
  CASE WHEN kind IN (0, 1, 3, 5, 6) THEN 'array' WHEN kind = 2 THEN 'path' ELSE 'none' END AS origin,
  path, CASE WHEN kind IN (0, 1, 3, 5, 6) THEN 16000 END AS sampling_rate
FROM audio_rows"""
)
def audio_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where each row's audio comes from: the chosen column, the fallback, a path, or nowhere."""
    rows = data.audio_rows(spark, folder)
    rows = rows.select("sample_id", audio_value(rows, "wav_path").alias("value"))
    value = F.col("value")
    return rows.select(
        "sample_id", audio_origin(value).alias("origin"), "value.path", "value.sampling_rate"
    )


@query(
    f"""WITH {sql.AUDIO}, usable AS (
  SELECT *, coalesce(path, 'sample_' || sample_id || '.wav') AS original
  FROM audio_rows WHERE kind IN (0, 1, 3, 5, 6)
)
SELECT sample_id,
  sample_id || coalesce('_speaker_' || speaker_id, '') || '_'
    || replace(regexp_replace(original, '^.*/', ''), '.wav', '') || '_score_' || grade || '.wav'
    AS file_name,
  sample_id || '_metadata.txt' AS metadata_name,
  'Sample index: ' || sample_id || chr(10) || coalesce('Speaker ID: ' || speaker_id || chr(10), '')
    || 'Original filename: ' || original || chr(10) || 'Truth score: ' || grade || chr(10)
    || 'Sampling rate: 16000 Hz' || chr(10) || 'Prompt: ' || prompt || chr(10)
    || coalesce('Language: ' || language || chr(10), '') AS metadata
FROM usable"""
)
def export_files(spark: SparkSession, folder: str) -> DataFrame:
    """File name and metadata text of every sample that has audio."""
    manifest, _ = export_manifest(data.audio_rows(spark, folder), "wav_path")
    return manifest


@query(
    f"""WITH {sql.AUDIO}, usable AS (
  SELECT *, coalesce(path, 'sample_' || sample_id || '.wav') AS original
  FROM audio_rows WHERE kind IN (0, 1, 3, 5, 6)
)
SELECT sample_id || '_metadata.txt' AS name,
  'Sample index: ' || sample_id || chr(10) || coalesce('Speaker ID: ' || speaker_id || chr(10), '')
    || 'Original filename: ' || original || chr(10) || 'Truth score: ' || grade || chr(10)
    || 'Sampling rate: 16000 Hz' || chr(10) || 'Prompt: ' || prompt || chr(10)
    || coalesce('Language: ' || language || chr(10), '') AS text
FROM usable"""
)
def export_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata texts as files under their own names, read back."""
    path = work_path(spark, "export-texts")
    manifest, _ = export_manifest(data.audio_rows(spark, folder), "wav_path")
    write_named_texts(manifest, path, "metadata_name", "metadata")
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")
    )


@query(f"WITH {sql.AUDIO} SELECT sample_id FROM audio_rows WHERE kind NOT IN (0, 1, 3, 5, 6)")
def export_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that cannot be exported."""
    _, skipped = export_manifest(data.audio_rows(spark, folder), "wav_path")
    return skipped


@query(
    f"""WITH {sql.PARSED_SCORES}, named AS (
  SELECT * REPLACE (CASE WHEN sample_id % 5 <> 0 THEN split END AS split) FROM parsed
), runs AS (
  SELECT dataset, split, {sql.SCORE_METRICS}, count(*) AS num_samples
  FROM named GROUP BY dataset, split
), placed AS (
  SELECT dataset, split,
    row_number() OVER (PARTITION BY dataset, split ORDER BY sample_id) - 1 AS place FROM named
)
SELECT dataset, split, place // 2000 * 2000 AS first_id, count(*) AS pairs, num_samples,
  printf('%.4f', accuracy) AS accuracy, printf('%.4f', absolute_accuracy) AS absolute_accuracy,
  printf('%.4f', binary_accuracy) AS binary_accuracy
FROM (SELECT placed.dataset, placed.split, place, runs.* EXCLUDE (dataset, split) FROM placed JOIN runs
  ON placed.dataset = runs.dataset AND placed.split IS NOT DISTINCT FROM runs.split) GROUP BY ALL"""
)
def documents_with_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Result documents that carry their run's metrics, as a reader finds them."""
    path = work_path(spark, "documents")
    by = ["dataset", "split"]
    rows = data.score_results(spark, folder).select(*by, "sample_id", "prediction", "label")
    rows = _some_unnamed(rows, "split")
    placed = with_position(rows, "sample_id", by).withColumn("sample_id", F.col("position"))
    write_documents(result_documents(placed, 2000, by, metrics(rows, by)), path)
    docs = read_result_documents(spark, path, multi_line=False)
    return docs.select(
        *by,
        "first_id",
        F.size("predictions_and_labels").cast("bigint").alias("pairs"),
        "num_samples",
        *[decimal_text(F.col(name), 4).alias(name) for name in METRIC_NAMES[:3]],
    )


@query(
    f"""WITH {sql.AUDIO}
SELECT sample_id, CASE WHEN kind IN (1, 3, 5) THEN 'array' WHEN clip_path IS NOT NULL THEN 'path'
  ELSE 'none' END AS origin, CASE WHEN kind NOT IN (1, 3, 5) THEN clip_path END AS path
FROM audio_rows"""
)
def audio_of_path_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A column of paths as the audio: the fallback is taken where it has samples."""
    rows = data.audio_rows(spark, folder)
    rows = rows.select("sample_id", audio_value(rows, "clip").alias("value"))
    return rows.select("sample_id", audio_origin(F.col("value")).alias("origin"), "value.path")


@query(
    """SELECT page_id AS sample_id, CASE WHEN page_id % 3 <> 0 THEN strlen(html)::BIGINT + 1 END AS bytes,
  CASE WHEN page_id % 3 <> 0 THEN md5(html || chr(10)) END AS digest
FROM pages"""
)
def attached_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that rows name by path, as bytes; two rows of three have one.

    The files are a page each, under names that the rows give.
    """
    root = work_path(spark, "clips")
    pages = data.table(spark, folder, "pages")
    has = F.col("page_id") % 3 != 0
    name = F.concat(F.lit("clip-"), F.col("page_id"), F.lit(".html"))
    text = F.concat(F.coalesce("html", F.lit("")), F.lit("\n"))
    write_named_texts(pages.where(has), root, name, text)
    audio = F.struct(
        F.lit(None).cast("array<float>").alias("array"),
        F.lit(None).cast("int").alias("sampling_rate"),
        F.when(has, name).alias("path"),
    )
    rows = pages.select(F.col("page_id").alias("sample_id"), audio.alias("audio"))
    found = attach_audio_files(rows, "audio", root)
    return found.select(
        "sample_id",
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.md5("content").alias("digest"),
    )


def _indented(frame: DataFrame, name: str, value: Column, path: str) -> None:
    """A file per row, named by ``name``, with ``value`` as indented JSON, as others write it.

    Tasks put the files where they belong, so the driver moves none of them.
    """
    text = F.concat(F.to_json(value, {"pretty": "true"}), F.lit("\n"))
    files = frame.select(F.concat(name, F.lit(".json")).alias("name"), text.alias("text"))
    write_named_texts(files.repartition("name"), path, "name", "text")


#: Ids that a document made elsewhere holds at most here.
FOREIGN_IDS = 700


def _foreign_documents(spark: SparkSession, folder: str, path: str) -> None:
    """Results as others write them, so many ids to a file; the file's name says which come first."""
    block = F.floor(F.col("sample_id") / FOREIGN_IDS)
    pairs = _placed(spark, folder).groupBy("dataset", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("sample_id", "prediction", "label"))).alias("pairs")
    )
    shown = F.transform("pairs", lambda p: F.struct(p["prediction"], p["label"]))
    named = pairs.withColumn("name", F.concat_ws("-", "dataset", "block"))
    _indented(named, "name", F.struct(shown.alias("predictions_and_labels")), path)


def _of_foreign_documents(rows: DataFrame) -> DataFrame:
    """``document`` as the dataset, and ids counted on from the file before."""
    name = F.regexp_extract("document", r"([^/]+)\.json$", 1)
    return rows.select(
        F.substring_index(name, "-", 1).alias("file"),
        (F.col("sample_id") + F.substring_index(name, "-", -1).cast("bigint") * FOREIGN_IDS).alias("sample_id"),
        "prediction",
        "label",
    )


@query(f"{PLACED} SELECT dataset AS file, sample_id, prediction, label FROM placed")
def indented_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Result documents in the layout that other programs write: one indented object a file."""
    path = work_path(spark, "indented")
    _foreign_documents(spark, folder, path)
    return _of_foreign_documents(result_rows(read_result_documents(spark, path), "document"))


@query(f"{PLACED} SELECT dataset AS file, sample_id, prediction, label FROM placed")
def indented_documents_by_line(spark: SparkSession, folder: str) -> DataFrame:
    """The same, read by lines, as documents are that no task could hold."""
    path = work_path(spark, "indented")
    _foreign_documents(spark, folder, path)
    return _of_foreign_documents(indented_result_rows(spark, path))


def _foreign_maps(spark: SparkSession, folder: str, path: str, named: bool = False) -> None:
    """All hints as indented maps; only if ``named`` do they say what they are of."""
    hints = hints_from_results(data.pair_results(spark, folder))
    block = F.floor(F.col("sample_id") / FOREIGN_IDS)
    maps = hints.groupBy("dataset", "split", block.alias("block")).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("sample_id").cast("string"), "hint")))
        ).alias("binary_predictions")
    )
    names = ["dataset", "split"] if named else []
    about = [F.lit("1764").alias("form_id"), F.lit("wav_path").alias("audio_column")]
    value = F.struct(*names, "binary_predictions", *about)
    _indented(maps.withColumn("name", F.concat_ws("_", "block", "dataset", "split")), "name", value, path)


def _foreign_hints(spark: SparkSession, folder: str) -> DataFrame:
    """The hints of maps made elsewhere: for each dataset and split, the caller names it and its files."""
    path = work_path(spark, "indented")
    _foreign_maps(spark, folder, path)
    runs = data.responses(spark, folder).select("dataset", "split").distinct().collect()
    maps = [
        read_hint_maps(spark, f"{path}/*_{dataset}_{split}.json", dataset=dataset, split=split)
        for dataset, split in sorted(runs)
    ]
    return hint_rows(reduce(DataFrame.unionByName, maps), "dataset", "split")


@query(f"WITH {sql.HINTS} SELECT dataset, split, sample_id, hint FROM hints")
def indented_prediction_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Maps made elsewhere, with dataset and split named by the caller."""
    return _foreign_hints(spark, folder)


@query(f"WITH {sql.HINTS} SELECT dataset, split, sample_id, hint, '1764' AS form_id FROM hints")
def indented_maps_by_line(spark: SparkSession, folder: str) -> DataFrame:
    """Maps that name their run, read by lines, as maps are that no task could hold."""
    path = work_path(spark, "indented")
    _foreign_maps(spark, folder, path, named=True)
    return indented_hint_rows(spark, path).select("dataset", "split", "sample_id", "hint", "form_id")


@query(
    f"""WITH {sql.HINTS}, base_rows AS (SELECT dataset, split, sample_id FROM responses)
SELECT dataset, split, count(*) AS responses, count(hint) AS hinted, count(hint) / count(*) AS rate
FROM base_rows LEFT JOIN hints USING (dataset, split, sample_id) GROUP BY dataset, split"""
)
def hints_that_match(spark: SparkSession, folder: str) -> DataFrame:
    """How many responses of each dataset and split the maps made elsewhere give a hint."""
    return hint_match_rate(data.responses(spark, folder), _foreign_hints(spark, folder))


@query(
    f"""WITH {sql.PARSED_PAIRS}, wide AS (
  SELECT dataset, {sql.PAIR_METRICS}, CAST(count(*) AS DOUBLE) AS num_samples
  FROM parsed GROUP BY dataset
)
SELECT dataset, 'eval/' || dataset AS binary_preds_path, round(binary_accuracy, 9) AS binary_accuracy FROM wide"""
)
def indented_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue as others write it: one indented object of all datasets."""
    path = work_path(spark, "catalogue")
    wide = metrics(data.pair_results(spark, folder), ["dataset"], mode="pair", metric="binary")
    preds = F.concat(F.lit("eval/"), F.col("dataset"))
    entries = catalogue_entries(wide, preds, F.lit("1764"), F.lit("wav_path"))
    entry = F.struct("dataset", F.struct("binary_preds_path", "form_id", "audio_column", "accuracy_metrics"))
    one = entries.agg(F.map_from_entries(F.collect_list(entry)).alias("all"))
    _indented(one.withColumn("name", F.lit("runs")), "name", F.col("all"), path)
    found = read_catalogue(spark, path)
    accuracy = F.round(F.col("accuracy_metrics")["binary_accuracy"], 9)
    return found.select("dataset", "binary_preds_path", accuracy.alias("binary_accuracy"))


@query(
    f"""WITH {sql.RESPONSES}
SELECT dataset, count(*) AS rows, false AS empty,
  CASE WHEN dataset IN ('click', 'view') THEN 'audio' ELSE 'prompt,audio' END AS missing
FROM responses GROUP BY dataset"""
)
def checked_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the columns that a job needs each dataset of a union lacks."""
    rows = data.responses(spark, folder)
    some = F.col("dataset").isin("click", "view")
    both = union_datasets([rows.where(some), rows.where(~some).drop("prompt")])
    return checked_columns(both, ["sample_id", "grade", "prompt", "audio"])
