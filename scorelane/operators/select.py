"""Choosing rows by index or speaker, and checks that two tables fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.functions.scores import strip_space
from scorelane.operators.keys import KEY, keyed


def select_by(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted.

    Spark broadcasts the wanted keys only if they are few. Otherwise they meet
    the rows by key, where a key with many rows is split over tasks.
    """
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def missing_from(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys that no row has, each once.

    The rows come down to the wanted keys first, so no other key is gathered.
    """
    asked = wanted.select(key).distinct()
    present = rows.select(key).join(asked, key, "left_semi").distinct()
    return asked.join(present, key, "left_anti")


def choose_samples(
    rows: DataFrame, indices: DataFrame | None = None, speakers: DataFrame | None = None
) -> DataFrame:
    """Rows by sample id or by speaker, never both."""
    if (indices is None) == (speakers is None):
        raise ValueError("give either indices or speakers")
    if speakers is not None:
        if "speaker_id" not in rows.columns:
            raise ValueError("speakers were asked for, but there is no speaker_id column")
        return select_by(rows, speakers, "speaker_id")
    return select_by(rows, indices, "sample_id")


def split_usable(rows: DataFrame, prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """Rows whose stripped prediction holds a comma, and the rejected others."""
    text = F.coalesce(F.col(prediction), F.lit(""))
    has_comma = text.contains(",")
    stripped = {prediction: strip_space(text)}
    return rows.where(has_comma).withColumns(stripped), rows.where(~has_comma).withColumns(stripped)


def unmatched_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys both sides share, and how many only one of them has.

    Rows are counted per key on each side before the shuffle, so a key that
    occurs often is one row by the time the sides meet. Null is a key like others.
    """
    lefts = keyed(left.select(*keys), keys).groupBy(KEY).agg(F.count("*").alias("left_rows"))
    rights = keyed(right.select(*keys), keys).groupBy(KEY).agg(F.count("*").alias("right_rows"))
    both = lefts.join(rights, KEY, "full_outer")
    return both.agg(
        F.count_if(F.col("left_rows").isNotNull() & F.col("right_rows").isNotNull()).alias(
            "matched"
        ),
        F.count_if(F.col("right_rows").isNull()).alias("left_only"),
        F.count_if(F.col("left_rows").isNull()).alias("right_only"),
    )


def require_matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Fail unless both sides have the same keys."""
    counts = unmatched_counts(left, right, keys).first()
    if counts.left_only or counts.right_only:
        raise ValueError(f"sides do not match: {counts.asDict()}")
