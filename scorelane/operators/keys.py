"""Keys whose columns may be null, where null is a value like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "_key"


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with their key as one struct, in which null equals null."""
    return rows.withColumn(KEY, F.struct(*keys))


def unnamed(keys: Sequence[str]) -> Column:
    """Whether a part of the key is null."""
    return reduce(or_, (F.col(key).isNull() for key in keys))


def matching(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A semi- or anti-join by ``keys``, null-safe.

    Rows that lie bucketed by their keys stay in place: Spark recognises them by plain
    columns only, so null-safe keys are used where the others have a null among theirs.
    Where they have none, a row with a null has no counterpart in either way.
    """
    others = others.select(*keys)
    if others.where(unnamed(keys)).isEmpty():
        return rows.join(others, list(keys), how)
    return keyed(rows, keys).join(keyed(others, keys).select(KEY), KEY, how).drop(KEY)
