"""First-stage predictions: made from results, joined to responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.operators.keys import KEY, keyed, matching, unnamed
from scorelane.operators.select import split_usable
from scorelane.schemas import NO_HINT

# The id comes first: a sort-merge join sorts by it, and compares names only on a tie.
HINT_KEYS = ("sample_id", "dataset", "split")


def hints_from_results(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Hints from result rows.

    ``strict`` strips the predictions and leaves out those without a comma;
    otherwise every prediction becomes a hint as it stands.
    """
    if strict:
        rows, _ = split_usable(rows)
    return rows.withColumnRenamed("prediction", "hint")


def settled_hints(
    hints: DataFrame, keys: Sequence[str] = HINT_KEYS, order: Sequence[str] = ()
) -> DataFrame:
    """One hint per key: of several the last by ``order``, and of those the greatest text.

    ``order`` names columns that sort by run, or by place in a map, as ``hint_rows``
    gives it: there the last entry of an id counts. A text comes before no text. Rows
    of a key are reduced before they meet, so a key that repeats often is no burden.
    """
    rank = F.struct(*order, F.col("hint").isNotNull().alias("_text"), F.col("hint").alias("_last"))
    kept = keyed(hints, keys).groupBy(KEY).agg(F.max(rank).alias("_rank"))
    return kept.select(*(F.col(f"{KEY}.{key}").alias(key) for key in keys), F.col("_rank._last").alias("hint"))


def hint_conflicts(hints: DataFrame, keys: Sequence[str] = HINT_KEYS) -> DataFrame:
    """Keys with hints that differ: how often they occur, and their least and greatest text."""
    found = keyed(hints, keys).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("hints"), F.min("hint").alias("least"), F.max("hint").alias("greatest"),
        F.count("hint").alias("_texts"),
    )
    differ = (F.col("least") != F.col("greatest")) | F.col("_texts").between(1, F.col("hints") - 1)
    return found.where(differ).select(f"{KEY}.*", "hints", "least", "greatest")


def attach_hints(
    responses: DataFrame,
    hints: DataFrame,
    keys: Sequence[str] = HINT_KEYS,
    default: str = NO_HINT,
    order: Sequence[str] = (),
) -> DataFrame:
    """Each response with its hint, or the default text; there are as many rows as responses.

    The full key names a response, so no key is hot, and hints of another split can
    never be joined by position. Null is a name like others. Where hints repeat a key,
    ``settled_hints`` decides by ``order``, and ``hint_conflicts`` tells. That is found
    out first, from the hints' keys alone, because responses that lie bucketed by plain
    keys then need not move. Spark picks broadcast or sort-merge from the hints' size.
    """
    chosen = hints.select(*keys, F.col("hint"), *(name for name in order if name not in (*keys, "hint")))
    counted = keyed(chosen, keys).groupBy(KEY).agg(F.count(F.lit(1)).alias("_hints"))
    odd = counted.select(f"{KEY}.*", "_hints").agg(
        F.coalesce(F.bool_or(F.col("_hints") > 1), F.lit(False)).alias("repeated"),
        F.coalesce(F.bool_or(unnamed(keys)), F.lit(False)).alias("unnamed"),
    ).first()
    if odd["repeated"]:
        chosen = settled_hints(chosen, keys, order)
    chosen = chosen.select(*keys, "hint")
    if odd["unnamed"]:
        named = keyed(chosen, keys).select(KEY, "hint")
        joined = keyed(responses, keys).join(named, KEY, "left").drop(KEY)
        joined = joined.select(*keys, *(c for c in joined.columns if c not in keys))
    else:
        joined = responses.join(chosen, list(keys), "left")
    return joined.withColumn("hint", F.coalesce("hint", F.lit(default)))


def hint_match_rate(
    responses: DataFrame,
    hints: DataFrame,
    keys: Sequence[str] = HINT_KEYS,
    by: Sequence[str] = ("dataset", "split"),
) -> DataFrame:
    """Per dataset and split: responses, those that have a hint, and their part. Only keys are read."""
    known = keyed(hints.select(*keys), keys).select(KEY).distinct().withColumn("_hinted", F.lit(1))
    matched = keyed(responses.select(*dict.fromkeys([*keys, *by])), keys).join(known, KEY, "left")
    return (
        matched.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("responses"), F.count("_hinted").alias("hinted"))
        .withColumn("rate", F.col("hinted") / F.col("responses"))
    )


def require_match(
    responses: DataFrame, hints: DataFrame, keys: Sequence[str] = HINT_KEYS
) -> DataFrame:
    """``responses``, if any of them has a hint; a set of hints that fits none is a mistake."""
    if matching(responses.select(*keys), hints, keys, "left_semi").isEmpty():
        raise ValueError(f"no hint fits a response by {list(keys)}")
    return responses


def without_hint(
    responses: DataFrame, hints: DataFrame, keys: Sequence[str] = HINT_KEYS
) -> DataFrame:
    """Responses that no hint was made for."""
    return matching(responses, hints, keys, "left_anti")


def zip_results(
    predictions: DataFrame, labels: DataFrame, keys: Sequence[str] = HINT_KEYS
) -> DataFrame:
    """Predictions beside their labels, by key rather than by row order.

    A prediction without label, or the reverse, fails the job. Null is a key like
    others; a key that occurs once on each side gives one row.
    """
    left = keyed(predictions, keys).drop(*keys).withColumn("_predicted", F.lit(True))
    right = keyed(labels, keys).drop(*keys).withColumn("_labelled", F.lit(True))
    both = left.join(right, KEY, "full_outer")
    both = both.select(f"{KEY}.*", *(c for c in both.columns if c != KEY))
    alone = F.raise_error(F.lit("predictions and labels do not match")).cast("boolean")
    matched = F.when(F.col("_predicted") & F.col("_labelled"), True).otherwise(alone)
    return both.where(matched).drop("_predicted", "_labelled")


def catalogue_lookup(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows with the path, form and audio column of their dataset's run.

    A dataset that the catalogue does not list fails the job.
    """
    entry = catalogue.select(
        F.col("dataset").alias("_dataset"), "binary_preds_path", "form_id", "audio_column"
    )
    joined = rows.join(entry, F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("dataset").isNotNull(), "left")
    missing = F.raise_error(F.concat(F.lit("no catalogue entry for dataset "), F.coalesce("dataset", F.lit("null"))))
    listed = F.when(F.col("_dataset").isNotNull(), True).otherwise(missing.cast("boolean"))
    return joined.where(listed).drop("_dataset")
