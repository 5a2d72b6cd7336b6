"""Evaluating a model: examples, scoring, results and metrics.

Results lie in a folder per model. Beside each lies a note of what made them: the
model and its version or code, the target and the prompt. Each row keeps a digest of
what the model was given, taken while it is scored, so a first run reads its examples
once. A run that finds results goes on with them only if the note is its own, and, if
it may grow, scores only examples that are new or have changed.

Joining hints to responses is the one step that could move audio. Keep large
response sets in a table bucketed by their key (``write_bucketed``): then only
the hints, a few bytes a row, are shuffled to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scorelane.functions.pairs import normalise_pair_text
from scorelane.functions.text import remove_markers
from scorelane.operators.hints import HINT_KEYS, hints_from_results
from scorelane.operators.identity import code_digest
from scorelane.operators.metrics import metrics
from scorelane.operators.position import take_first
from scorelane.operators.prompts import hint_examples, supervised_examples
from scorelane.operators.scoring import ScorerFactory, score_batches
from scorelane.plans.resume import DIGEST, scored_parts
from scorelane.schemas import NO_HINT
from scorelane.sinks.results import (
    catalogue_entries,
    folder_name,
    hint_maps,
    write_catalogue,
    write_documents,
)
from scorelane.sources.responses import require_rows


@dataclass(frozen=True)
class Model:
    """A scorer and the name its results go by.

    ``version`` tells builds of a model apart. Without one a digest of the factory's
    code does, which does not see weights that the factory loads. ``max_bytes`` bounds
    a batch beside ``batch_size``.
    """

    name: str
    factory: ScorerFactory
    inputs: tuple[str, ...] = ("prompt_text", "audio")
    batch_size: int = 4
    arrow: bool = False
    version: str | None = None
    max_bytes: int | None = None

    @property
    def folder(self) -> str:
        """The model's name as a folder that no other name has."""
        plain = re.sub(r"[^A-Za-z0-9.-]", "_", self.name)
        return f"{plain}_{hashlib.md5(self.name.encode()).hexdigest()[:8]}"


def score(examples: DataFrame, model: Model, keys: Sequence[str] = HINT_KEYS) -> DataFrame:
    """Predictions beside labels, by response."""
    keep = [*keys, "label", *([DIGEST] if DIGEST in examples.columns else [])]
    return score_batches(
        examples, model.name, model.factory, model.inputs, keep, model.batch_size, arrow=model.arrow,
        max_bytes=model.max_bytes,
    )


def score_answers(
    examples: DataFrame, model: Model, target: str = "score", keys: Sequence[str] = HINT_KEYS
) -> DataFrame:
    """Single answers as they are shown: ``answer`` is the prediction without markers.

    Pairs are normalised too. ``prediction`` stays as the model gave it.
    """
    cleaned = remove_markers(F.col("prediction"))
    if target == "pair":
        cleaned = normalise_pair_text(cleaned)
    return score(examples, model, keys).withColumn("answer", cleaned)


def ready(responses: DataFrame, limit: int | None, by: Sequence[str] = ("dataset", "split")) -> DataFrame:
    """Responses to be scored: at least one, and at most ``limit`` of each dataset and split."""
    require_rows(responses)
    if limit is None:
        return responses
    return take_first(responses, "sample_id", limit, by).drop("position")


def _identity(model: Model, **how: str) -> dict[str, str]:
    """What results are made by. Audio is told by the rest of its row, and is not read for it."""
    build = {"scorer": code_digest(model.factory)} if model.version is None else {"version": model.version}
    return {"model": model.name, "inputs": ",".join(model.inputs), **build, **how}


def _scored(
    spark: SparkSession, path: str, examples: DataFrame, model: Model, by: Sequence[str], how: dict[str, str], **kept
) -> DataFrame:
    return scored_parts(
        spark,
        path,
        examples,
        lambda part: score(part, model),
        HINT_KEYS,
        ["label", "prompt_text", *model.inputs],
        by,
        _identity(model, **how),
        **kept,
    )


def evaluate(
    spark: SparkSession,
    responses: DataFrame,
    model: Model,
    path: str,
    target: str = "score",
    metric: str = "both",
    by: Sequence[str] = ("dataset", "split"),
    reuse: bool = True,
    limit: int | None = None,
    grow: bool = False,
    parts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Result rows, written in the model's folder below ``path``, and metrics per dataset and split.

    All datasets go through one plan: there is no loop over a work list. ``limit``
    is the number of responses of each that are scored. With ``grow`` a finished run
    is brought up to date: responses that are new or changed are scored, the others
    keep their predictions. ``parts`` is the number of jobs that a run is dealt to.
    """
    variant = "audio_first" if target == "score" else "question_first"
    examples = supervised_examples(ready(responses, limit), target, variant)
    how = {"target": target, "variant": variant}
    rows = _scored(
        spark, f"{path}/{model.folder}", examples, model, by, how, reuse=reuse, grow=grow, parts=parts
    )
    return rows, metrics(rows, by, mode=target, metric=metric)


def evaluate_with_catalogue(
    spark: SparkSession,
    responses: DataFrame,
    model: Model,
    path: str,
    form_id: Column,
    audio_column: str,
    slice_rows: int,
    reuse: bool = True,
) -> DataFrame:
    """Run a pass/fail model over all datasets of a split, and return its metrics.

    Leaves results, prediction maps and the catalogue below ``path``. Maps lie
    in a folder per dataset, which the catalogue names, ``slice_rows`` ids each.
    Forms follow from ``form_id``, an expression over ``dataset``.
    """
    by, folder = ["dataset"], folder_name(F.col("dataset"))
    rows, _ = evaluate(spark, responses, model, f"{path}/results", "pair", "binary", reuse=reuse)
    maps = hint_maps(hints_from_results(rows), audio_column, slice_rows, form_id, by)
    write_documents(maps.withColumn("folder", folder), f"{path}/preds", ["folder"])
    wide = metrics(rows, by, mode="pair", metric="binary")
    location = F.concat(F.lit(f"{path}/preds/folder="), folder)
    entries = catalogue_entries(wide, location, form_id, F.lit(audio_column))
    write_catalogue(entries, f"{path}/catalogue")
    return wide


def cascade(
    spark: SparkSession,
    responses: DataFrame,
    first: Model,
    second: Model,
    path: str,
    metric: str = "both",
    by: Sequence[str] = ("dataset", "split"),
    strict: bool = False,
    reuse: bool = True,
    limit: int | None = None,
    grow: bool = False,
    parts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Pass or fail first, then a score that is guided by it.

    The first stage is written before the second reads it as hints, and the
    second before its metrics are taken, so each model runs once, and each stage
    reads the responses once. Where no hint fits a response the job fails: how many
    do is counted while the second stage is scored, and its rows then do not count.
    Responses in a table bucketed by their key (``write_bucketed``) stay where they
    are in both stages. Where the first stage's answer to a response changes, its
    prompt does, and a run that may ``grow`` scores it anew.
    """
    responses = ready(responses, limit)
    kept = {"reuse": reuse, "grow": grow, "parts": parts}
    first_rows, _ = evaluate(spark, responses, first, f"{path}/first", "pair", "binary", by, **kept)
    hints = hints_from_results(first_rows, strict)
    if hints.isEmpty():
        raise ValueError(f"no hint fits a response by {list(HINT_KEYS)}: there are none")
    examples = hint_examples(responses, hints, variant="no_question")
    #: The first is of the plan that only tells the schema.
    seen: list[Observation] = []

    def build(part: DataFrame) -> DataFrame:
        seen.append(Observation())
        return score(part.observe(seen[-1], F.count_if(F.col("hint") != NO_HINT).alias("hinted")), second)

    def accept() -> None:
        if not any(one.get["hinted"] for one in seen[1:]):
            raise ValueError(f"no hint fits a response by {list(HINT_KEYS)}")

    rows = scored_parts(
        spark,
        f"{path}/second/{second.folder}",
        examples,
        build,
        HINT_KEYS,
        ["label", "prompt_text", *second.inputs],
        by,
        _identity(second, first=first.name),
        accept=accept,
        **kept,
    )
    return rows, metrics(rows, by, metric=metric)
