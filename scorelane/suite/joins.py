"""Hints, selections, checks of fit, positions, shards and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators.hints import (
    attach_hints,
    hint_conflicts,
    hint_match_rate,
    hints_from_results,
    without_hint,
    zip_results,
)
from scorelane.operators.position import (
    batch_number,
    drop_short_batch,
    ordered_position,
    shard_number,
    take_first,
    with_position,
)
from scorelane.operators.select import (
    choose_samples,
    missing_from,
    split_usable,
    unmatched_counts,
)
from scorelane.suite import data, sql
from scorelane.suite.registry import query


@query(
    f"""WITH {sql.HINTS}
SELECT r.sample_id, r.dataset, r.split, coalesce(h.hint, 'No binary prediction') AS hint
FROM pairs r LEFT JOIN hints h USING (dataset, split, sample_id)"""
)
def responses_with_hints(spark: SparkSession, folder: str) -> DataFrame:
    results = data.pair_results(spark, folder)
    rows = attach_hints(data.responses(spark, folder), hints_from_results(results))
    return rows.select("sample_id", "dataset", "split", "hint")


@query(
    f"""WITH {sql.HINTS}
SELECT sample_id, dataset, split FROM pairs WHERE NOT contains(prediction, ',')"""
)
def responses_without_hint(spark: SparkSession, folder: str) -> DataFrame:
    results = data.pair_results(spark, folder)
    rows = without_hint(data.responses(spark, folder), hints_from_results(results))
    return rows.select("sample_id", "dataset", "split")


@query(f"WITH {sql.PAIRS} SELECT sample_id, prediction AS hint FROM pairs")
def hints_as_they_stand(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction becomes a hint, unstripped and whether or not it is a pair."""
    hints = hints_from_results(data.pair_results(spark, folder), strict=False)
    return hints.select("sample_id", "hint")


@query(
    f"""WITH {sql.PAIRS}
SELECT dataset, contains(prediction, ',') AS usable, count(*) AS predictions FROM pairs GROUP BY ALL"""
)
def usable_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """How many predictions can be hints and how many are rejected."""
    usable, rejected = split_usable(data.pair_results(spark, folder))
    both = usable.select("dataset", F.lit(True).alias("usable")).union(
        rejected.select("dataset", F.lit(False).alias("usable"))
    )
    return both.groupBy("dataset", "usable").agg(F.count("*").alias("predictions"))


@query(f"WITH {sql.SCORES} SELECT dataset, split, sample_id, prediction, label FROM scores")
def predictions_beside_labels(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["dataset", "split", "sample_id"]
    rows = data.score_results(spark, folder)
    return zip_results(rows.select(*keys, "prediction"), rows.select(*keys, "label"))


@query(
    """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched,
  count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only
FROM (SELECT DISTINCT doc_id FROM documents) d
  FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""
)
def documents_against_labels(spark: SparkSession, folder: str) -> DataFrame:
    documents = data.table(spark, folder, "documents")
    return unmatched_counts(documents, data.table(spark, folder, "labels"), ["doc_id"])


UNNAMED = f"""{sql.HINTS}, asked AS (
  SELECT sample_id, CASE WHEN dataset <> 'click' THEN dataset END AS dataset,
    CASE WHEN sample_id % 5 > 0 THEN split END AS split, prediction, label
  FROM pairs
), given AS (
  SELECT sample_id, dataset, split, trim(prediction, {sql.SPACE}) AS hint, 1 AS run
  FROM asked WHERE contains(prediction, ',')
  UNION ALL
  SELECT sample_id, dataset, split, trim(prediction, {sql.SPACE}) || ' again', 2
  FROM asked WHERE contains(prediction, ',') AND sample_id % 3 = 0
  UNION ALL
  SELECT sample_id, dataset, split, trim(prediction, {sql.SPACE}), 2
  FROM asked WHERE contains(prediction, ',') AND sample_id % 4 = 0
)"""

KEYS = ("sample_id", "dataset", "split")


def _unnamed(rows: DataFrame) -> DataFrame:
    """Rows of which one dataset and some splits have no name."""
    return rows.withColumns(
        {
            "dataset": F.when(F.col("dataset") != "click", F.col("dataset")),
            "split": F.when(F.col("sample_id") % 5 > 0, F.col("split")),
        }
    )


def _repeated(results: DataFrame) -> DataFrame:
    """Hints of two runs; the second repeats some with another text, some with the same."""
    hints = hints_from_results(results).select(*KEYS, "hint").withColumn("run", F.lit(1))
    other = hints.where(F.col("sample_id") % 3 == 0).withColumns(
        {"hint": F.concat("hint", F.lit(" again")), "run": F.lit(2)}
    )
    same = hints.where(F.col("sample_id") % 4 == 0).withColumn("run", F.lit(2))
    return hints.unionByName(other).unionByName(same)


@query(
    f"""WITH {UNNAMED}
SELECT a.sample_id, a.dataset, a.split, coalesce(h.hint, 'No binary prediction') AS hint
FROM asked a LEFT JOIN (
  SELECT sample_id, dataset, split, arg_max(hint, (run, hint)) AS hint FROM given GROUP BY sample_id, dataset, split
) h ON a.sample_id = h.sample_id AND a.dataset IS NOT DISTINCT FROM h.dataset
  AND a.split IS NOT DISTINCT FROM h.split"""
)
def unnamed_responses_with_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Null names are names like others, and of repeated hints the last run's counts."""
    results = _unnamed(data.pair_results(spark, folder))
    rows = attach_hints(_unnamed(data.responses(spark, folder)), _repeated(results), order=["run"])
    return rows.select(*KEYS, "hint")


@query(
    f"""WITH {UNNAMED}
SELECT sample_id, dataset, split, count(*) AS hints, min(hint) AS least, max(hint) AS greatest
FROM given GROUP BY sample_id, dataset, split HAVING count(DISTINCT hint) > 1"""
)
def conflicting_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that two runs gave different hints."""
    return hint_conflicts(_repeated(_unnamed(data.pair_results(spark, folder))))


@query(f"WITH {UNNAMED} SELECT sample_id, dataset, split FROM asked WHERE NOT contains(prediction, ',')")
def unnamed_responses_without_hint(spark: SparkSession, folder: str) -> DataFrame:
    results = _unnamed(data.pair_results(spark, folder))
    rows = without_hint(_unnamed(data.responses(spark, folder)), hints_from_results(results))
    return rows.select(*KEYS)


@query(
    f"""WITH {UNNAMED}
SELECT dataset, split, count(*) AS responses, count(*) FILTER (contains(prediction, ',')) AS hinted,
  count(*) FILTER (contains(prediction, ',')) / count(*) AS rate
FROM asked GROUP BY dataset, split"""
)
def unnamed_match_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated hints count once, and null names have a rate of their own."""
    results = _unnamed(data.pair_results(spark, folder))
    return hint_match_rate(_unnamed(data.responses(spark, folder)), _repeated(results))


@query(f"WITH {UNNAMED} SELECT sample_id, dataset, split, prediction, label FROM asked")
def unnamed_predictions_beside_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _unnamed(data.pair_results(spark, folder))
    return zip_results(rows.select(*KEYS, "prediction"), rows.select(*KEYS, "label"))


@query(
    """WITH d AS (SELECT DISTINCT CASE WHEN doc_id % 9 > 0 THEN doc_id END AS k, lang FROM documents),
l AS (
  SELECT DISTINCT CASE WHEN doc_id % 9 > 0 THEN doc_id END AS k, lang FROM documents WHERE doc_id % 4 <> 1
)
SELECT count(*) FILTER (d.lang IS NOT NULL AND l.lang IS NOT NULL) AS matched,
  count(*) FILTER (l.lang IS NULL) AS left_only, count(*) FILTER (d.lang IS NULL) AS right_only
FROM d FULL JOIN l ON d.k IS NOT DISTINCT FROM l.k AND d.lang = l.lang"""
)
def unnamed_documents_against_others(spark: SparkSession, folder: str) -> DataFrame:
    """Null keys on both sides are one key."""
    number = F.col("doc_id")
    documents = data.table(spark, folder, "documents").select(F.when(number % 9 > 0, number).alias("k"), "lang", "doc_id")
    return unmatched_counts(documents, documents.where(number % 4 != 1), ["k", "lang"])


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, speaker_id, grade FROM responses
WHERE speaker_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def samples_of_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of the speakers another table lists."""
    speakers = (
        data.table(spark, folder, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("speaker_id"))
    )
    rows = choose_samples(data.responses(spark, folder), speakers=speakers)
    return rows.select("sample_id", "speaker_id", "grade")


@query(
    f"""WITH {sql.RESPONSES}
SELECT sample_id, dataset, grade FROM responses
WHERE sample_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def samples_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """Responses whose index another table lists, some more than once."""
    indices = _indices(spark, folder)
    rows = choose_samples(data.responses(spark, folder), indices=indices)
    return rows.select("sample_id", "dataset", "grade")


@query(
    """SELECT DISTINCT l_orderkey AS sample_id FROM lineitem
WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT event_id FROM events)"""
)
def indices_out_of_range(spark: SparkSession, folder: str) -> DataFrame:
    """Listed indices that no response has."""
    return missing_from(data.responses(spark, folder), _indices(spark, folder), "sample_id")


def _indices(spark: SparkSession, folder: str) -> DataFrame:
    returned = data.table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return returned.select(F.col("l_orderkey").alias("sample_id"))


POSITIONS = f"""WITH {sql.RESPONSES}, placed AS (
  SELECT sample_id, dataset,
    row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS position,
    count(*) OVER (PARTITION BY dataset) AS total
  FROM responses
)"""


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.responses(spark, folder).select("sample_id", "dataset")
    # small buckets, so that the test tables fill more than one
    return with_position(rows, "sample_id", ["dataset"], bucket_bits=8)


@query(f"{POSITIONS} SELECT sample_id, dataset, position, total FROM placed")
def positions_in_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder)


@query(
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS total
FROM documents"""
)
def positions_overall(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.table(spark, folder, "documents").select("doc_id")
    return with_position(rows, "doc_id", bucket_bits=7)


@query(
    """SELECT name, brand, part, row_number() OVER (PARTITION BY brand ORDER BY name NULLS FIRST, part) - 1 AS position,
  count(*) OVER (PARTITION BY brand) AS total
FROM (SELECT p_partkey AS part, CASE WHEN p_partkey % 10 > 0 THEN p_name END AS name,
  CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS brand FROM part)"""
)
def positions_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Parts numbered by name inside their brand, where names repeat and some are null, as are brands."""
    number = F.col("p_partkey")
    parts = data.table(spark, folder, "part").select(
        number.alias("part"),
        F.when(number % 10 > 0, F.col("p_name")).alias("name"),
        F.when(number % 7 > 0, F.col("p_brand")).alias("brand"),
    )
    return ordered_position(parts, ["name", "part"], ["brand"])


@query(f"{POSITIONS} SELECT sample_id, dataset, position FROM placed WHERE position < 25")
def first_of_each_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 responses of each dataset."""
    rows = data.responses(spark, folder).select("sample_id", "dataset")
    return take_first(rows, "sample_id", 25, ["dataset"])


@query(f"{POSITIONS} SELECT sample_id, dataset, position FROM placed WHERE position < 1500")
def first_many_of_each_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """So many responses of each dataset that all are numbered."""
    rows = data.responses(spark, folder).select("sample_id", "dataset")
    return take_first(rows, "sample_id", 1500, ["dataset"])


@query(
    f"""{POSITIONS}, cut AS (
  SELECT dataset, sample_id, position,
    ntile(7) OVER (PARTITION BY dataset ORDER BY sample_id) - 1 AS contiguous FROM placed
)
SELECT dataset, sample_id, contiguous, position % 7 AS modulo FROM cut"""
)
def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of each response, dealt out in runs and in turn."""
    position, total = F.col("position"), F.col("total")
    return _positions(spark, folder).select(
        "dataset",
        "sample_id",
        shard_number(position, 7, "contiguous", total).alias("contiguous"),
        shard_number(position, 7, "modulo").alias("modulo"),
    )


@query(
    f"""{POSITIONS}
SELECT dataset, position // 16 AS batch, count(*) AS batch_rows, position // 16 < total // 16 AS kept
FROM placed GROUP BY ALL"""
)
def batches_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 16, and which of them training keeps."""
    placed = _positions(spark, folder)
    batch = batch_number(F.col("position"), 16).alias("batch")
    sizes = placed.groupBy("dataset", batch).agg(F.count("*").alias("batch_rows"))
    full = drop_short_batch(placed, 16).groupBy("dataset", batch).agg(F.lit(True).alias("full"))
    return sizes.join(full, ["dataset", "batch"], "left").select(
        "dataset", "batch", "batch_rows", F.coalesce("full", F.lit(False)).alias("kept")
    )
