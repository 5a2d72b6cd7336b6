"""Quality scores by naive Bayes features and a linear hinge-loss model.

A document's features say which n-grams it has: words and pairs of words, and
runs of one to three word shapes (letter case, digits, marks, a repeated word).
They are hashed to a fixed number of columns. Each is scaled by its log-count
ratio between the classes, then a linear model with hinge loss is fitted by dual
coordinate descent, and a sigmoid of its margin is the score.

The model is fitted on at most ``SAMPLE`` labelled documents, those whose id has
the smallest hash; that bound keeps the fit on the driver small. Every document
is scored over its whole text. Labels, language, source and id are not features.

Defined results: null and empty texts are scored as a text without features;
labels that are null are left out, of several for a document the smallest holds;
if the labels have one class only, every score is that class, without labels 0.5;
a null ``doc_id`` is scored, and held out, as its text has remainder 0; repeated rows
are each scored, and count once in the fit, as do several texts of one id (the one
with the least columns counts); a text of any length is read whole, and holds a few
numbers a word; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.llm.common import kept_by_worker, quoted, staged, struct_of

SAMPLE = 8000
COLUMNS = 1 << 20
FOLDS = 5
ACCEPTED = 0.3
#: Words whose hashes a worker keeps, some 200 bytes each.
KEPT_WORDS = 300_000

_CASES = str.maketrans(
    {c: "X" for c in map(chr, range(0x250)) if c.isupper()}
    | {c: "x" for c in map(chr, range(0x250)) if c.isalpha() and not c.isupper()}
    | {c: "9" for c in "0123456789"}
)
_RUN = re.compile(r"(.)\1+")
_SAME = 0xFFFF


class _Words(dict):
    """Words to a number of their hash (32 bits) and their shape's (16 bits)."""

    def __missing__(self, word: str) -> int:
        shape = _RUN.sub(r"\1", word.translate(_CASES))
        found = zlib.crc32(word.encode()) << 16 | zlib.crc32(shape.encode()) % _SAME
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


def worker_words() -> _Words:
    return kept_by_worker("words", _Words)


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Columns of n-grams, by multiplying and adding their parts' hashes."""
    value = np.full(len(parts[0]), kind, np.uint64)
    for part in parts:
        value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value & np.uint64(COLUMNS - 1)


def features(text: str | None, words: _Words) -> np.ndarray:
    """The columns that a text has, each once."""
    parts = (text or "").split()
    held = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    word, shape = held >> np.uint64(16), held & np.uint64(0xFFFF)
    shape[1:][word[1:] == word[:-1]] = _SAME
    grams = [
        _mixed(1, word),
        _mixed(2, word[:-1], word[1:]),
        _mixed(3, shape),
        _mixed(4, shape[:-1], shape[1:]),
        _mixed(5, shape[:-2], shape[1:-1], shape[2:]),
    ]
    return np.unique(np.concatenate(grams)).astype(np.int32)


@dataclass
class Model:
    """Ratios and weights by column, and the sigmoid of the margin."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, columns: np.ndarray) -> float:
        ratio = self.ratios[columns]
        norm = float(np.sqrt(ratio @ ratio)) or 1.0
        return float(ratio @ self.weights[columns]) / norm + self.bias

    def score(self, columns: np.ndarray) -> float:
        return float(_sigmoid(self.slope * self.margin(columns) + self.shift))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of a column's share in good documents over that in bad; 0 where there is none."""
    counts = []
    for label in (True, False):
        held = [row for row, is_good in zip(rows, good, strict=True) if is_good == label]
        count = np.bincount(np.concatenate(held), minlength=COLUMNS) if held else np.zeros(COLUMNS)
        counts.append(count)
    shares = [(c + smooth) / (c + smooth).sum() for c in counts]
    return np.where(counts[0] + counts[1] > 0, np.log(shares[0] / shares[1]), 0).astype(np.float32)


def dual_descent(
    rows: list[np.ndarray],
    values: list[np.ndarray],
    good: np.ndarray,
    cost: float = 1.0,
    rounds: int = 30,
    close: float = 0.01,
    seed: int = 42,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a hinge-loss model, by coordinate descent on its dual.

    Classes cost as much in sum. Rounds stop when no step would change a dual
    variable by more than ``close`` of its gradient.
    """
    weights, bias = np.zeros(COLUMNS, np.float64), 0.0
    sign = np.where(good, 1.0, -1.0)
    share = good.mean()
    most = np.where(good, cost / (2 * share), cost / (2 * (1 - share)))
    dual = np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.arange(len(rows))
    chance = np.random.default_rng(seed)
    for _ in range(rounds):
        chance.shuffle(order)
        worst = 0.0
        for i in order:
            row, value, y = rows[i], values[i], sign[i]
            slope = y * (value @ weights[row] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), most[i])
            step = new - dual[i]
            if step:
                worst = max(worst, abs(slope))
                dual[i] = new
                weights[row] += step * y * value
                bias += step * y
        if worst < close:
            break
    return weights.astype(np.float32), bias


def _platt(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps, with smoothed targets."""
    n, p = len(good), int(good.sum())
    target = np.where(good, (p + 1) / (p + 2), 1 / (n - p + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        found = _sigmoid(slope * margins + shift)
        weight = found * (1 - found) + 1e-9
        error = found - target
        gradient = np.array([error @ margins + 1e-3 * slope, error.sum()])
        curve = np.array(
            [[weight @ margins**2 + 1e-3, weight @ margins], [weight @ margins, weight.sum()]]
        )
        step = np.linalg.solve(curve + 1e-9 * np.eye(2), gradient)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(shift)


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model; every fifth row only fits the sigmoid."""
    nothing = np.zeros(COLUMNS, np.float32)
    if good.all() or not good.any():
        shift = 0.0 if not len(good) else 40.0 if good.all() else -40.0
        return Model(nothing, nothing, 0.0, 0.0, shift)
    aside = np.arange(len(rows)) % 5 == 4
    if len({*good[~aside]}) < 2 or len({*good[aside]}) < 2:
        aside[:] = False
    kept = [i for i in range(len(rows)) if not aside[i]]
    fit_rows, fit_good = [rows[i] for i in kept], good[~aside]
    ratios = log_count_ratios(fit_rows, fit_good)
    values = []
    for row in fit_rows:
        value = ratios[row].astype(np.float64)
        values.append(value / (np.sqrt(value @ value) or 1.0))
    weights, bias = dual_descent(fit_rows, values, fit_good)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    held = [i for i in range(len(rows)) if aside[i]] or kept
    margins = np.array([model.margin(rows[i]) for i in held])
    model.slope, model.shift = _platt(margins, good[held])
    return model


def fold(doc_id: Column) -> Column:
    """The remainder that says which documents are held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality`` from at most ``sample`` documents that are not held out."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        for batch in batches:
            found = [features(text.as_py(), words) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "quality", "columns"],
            )

    # The sample is bounded, so it may be broadcast and its features collected.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    found = rows.mapInArrow(run, struct_of(f"doc_id {dict(rows.dtypes)['doc_id']}, quality int, columns array<int>"))
    # Of several texts under one id the one with the least columns counts, so a rerun fits the same model.
    one = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("columns").alias("columns"))
    held = one.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    columns = [np.asarray(row.values.to_numpy(zero_copy_only=False)) for row in held.column("columns")]
    return train(columns, np.array(held.column("quality").to_pylist(), dtype=float) == 1)


def scored(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, and its score as ``__scorelane_score``."""
    sent = keep if "text" in keep else [*keep, "text"]
    at = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        for batch in batches:
            found = [model.score(features(text.as_py(), words)) for text in batch.column(at)]
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = documents.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(sent)))
    kinds = [T.StructField(f"c{i}", rows.schema[f"c{i}"].dataType) for i in range(len(keep))]
    schema = T.StructType([*kinds, T.StructField("__scorelane_score", T.DoubleType())])
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "__scorelane_score")


def quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    found = scored(documents, fit(documents, labels, sample), ["doc_id"])
    return found.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("__scorelane_score").alias("score"),
        (F.col("__scorelane_score") >= ACCEPTED).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    columns = documents.columns
    found = scored(documents, fit(documents, labels, sample), columns)
    return found.where(F.col("__scorelane_score") >= ACCEPTED).drop("__scorelane_score")
