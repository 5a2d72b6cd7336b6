"""Answer suffixes, stop markers, and the names of runs and files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelane.functions.scores import strip_space
from scorelane.schemas import ANSWER_SUFFIX, DEFAULT_FORM, OTHER_FORM, STOP_MARKERS


def add_suffix(answer: Column, suffix: str = ANSWER_SUFFIX) -> Column:
    return F.concat(answer.cast("string"), F.lit(suffix))


def remove_suffix(text: Column, suffix: str = ANSWER_SUFFIX) -> Column:
    cut = F.left(text, F.length(text) - len(suffix))
    return F.when(text.endswith(suffix), cut).otherwise(text)


def remove_markers(text: Column, markers: Sequence[str] = STOP_MARKERS) -> Column:
    """Drop stop markers wherever they stand, then strip."""
    for marker in markers:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return strip_space(text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def form_of(path: Column) -> Column:
    return F.when(path.contains(OTHER_FORM), OTHER_FORM).otherwise(DEFAULT_FORM)


def dataset_of(path: Column, names: Mapping[str, str], default: str) -> Column:
    """The dataset whose key occurs in the path; the first key that fits wins."""
    found = F.lit(default)
    for part, name in reversed(list(names.items())):
        found = F.when(path.contains(part), name).otherwise(found)
    return found


def result_name(model: Column, dataset: Column, split: Column, suffix: str = "") -> Column:
    return F.concat(
        base_name(model), F.lit("_"), base_name(dataset), F.lit("_"), split, F.lit(f"{suffix}.json")
    )


def read_result_name(
    path: Column, datasets: Sequence[str], splits: Sequence[str], suffixes: Sequence[str] = ()
) -> Column:
    """Model, dataset and split of a result name.

    All three may hold underscores, so the known datasets and splits decide.
    """

    def any_of(words: Sequence[str]) -> str:
        return "|".join(re.escape(word) for word in sorted(words, key=len, reverse=True))

    tail = f"({any_of(suffixes)})?" if suffixes else "()"
    pattern = rf"^(.+)_({any_of(datasets)})_({any_of(splits)}){tail}\.json$"
    name = base_name(path)
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    fields = zip(parts, ("model", "dataset", "split"))
    return F.struct(*[F.nullif(part, F.lit("")).alias(field) for part, field in fields])


def predictions_path(path: Column) -> Column:
    """Where the predictions of a result file go: ``results`` in its base name becomes ``preds``."""
    name = base_name(path)
    folder = F.left(path, F.length(path) - F.length(name))
    return F.concat(folder, F.regexp_replace(name, "^(.*?)results", "$1preds"))


def model_id(model: Column, default: str, form_id: Column) -> Column:
    """The default model id gets its form as a suffix; others stay."""
    return F.when(model == default, F.concat(model, F.lit("_"), form_id)).otherwise(model)
