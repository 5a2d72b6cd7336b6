"""Batch scoring with an external model: the one place where Python sees the rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import types as T

import scorelane
from scorelane.operators.identity import code_digest

Scorer = Callable[[pd.DataFrame], Sequence[str]]
ScorerFactory = Callable[[], Scorer]

# Our functions travel with the plan, so executors need not have this package.
register_pickle_by_value(scorelane)


def _scorer(key: str, factory: ScorerFactory) -> Scorer:
    """The scorer, loaded once per Python worker.

    Spark keeps workers between tasks. Functions that travel bring their own
    globals each time, so the model is kept in a module of the worker's. There is
    one at a time: a second model, as in a cascade, takes the place of the first.
    """
    held = sys.modules.setdefault("scorelane_models", ModuleType("scorelane_models"))
    if getattr(held, "key", None) != key:
        held.key = held.scorer = None
        held.scorer = factory()
        held.key = key
    return held.scorer


def _size(value: object) -> int:
    """The bytes of a value about, nested ones included."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, np.ndarray):
        return value.nbytes if value.dtype != object else sum(map(_size, value))
    if isinstance(value, dict):
        return sum(map(_size, value.values()))
    return sum(map(_size, value)) if isinstance(value, (list, tuple)) else 8


def _frame_sizes(rows: pd.DataFrame) -> list[int]:
    total = np.zeros(len(rows), np.int64)
    for name in rows.columns:
        nested = rows[name].dtype == object
        total += np.fromiter(map(_size, rows[name]), np.int64, len(rows)) if nested else 8
    return total.tolist()


def _table_sizes(rows: pa.Table) -> list[int]:
    return [rows.slice(at, 1).nbytes for at in range(rows.num_rows)]


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Frames one after the other; texts as plain objects, as Spark takes no arrays in chunks."""
    if len(frames) == 1:
        return frames[0].reset_index(drop=True)
    joined = pd.concat(frames, ignore_index=True)
    chunked = [name for name in joined.columns if isinstance(joined[name].dtype, (pd.StringDtype, pd.ArrowDtype))]
    return joined.astype(dict.fromkeys(chunked, object))


def batch_ends(sizes: Sequence[int], batch_size: int, max_bytes: int | None, last: bool) -> list[int]:
    """Where batches end that hold at most ``batch_size`` rows, and ``max_bytes`` unless one row is larger.

    Rows of a batch that is not full end only if they are the ``last``.
    """
    ends, count, total = [], 0, 0
    for at, size in enumerate(sizes):
        if count and (count == batch_size or (max_bytes is not None and total + size > max_bytes)):
            ends.append(at)
            count = total = 0
        count, total = count + 1, total + size
    if count == batch_size or (last and count):
        ends.append(len(sizes))
    return ends


def score_batches(
    rows: DataFrame,
    name: str,
    factory: ScorerFactory,
    inputs: Sequence[str],
    keep: Sequence[str],
    batch_size: int = 4,
    output: str = "prediction",
    arrow: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Run a scorer over ``inputs``, ``batch_size`` rows at a time, and keep ``keep``.

    With ``max_bytes`` a batch is closed earlier where its inputs would be larger, so a
    few long recordings do not outgrow what the model can take; a row that is larger
    by itself is a batch of its own. Rows keep their order, and batches go on from one
    Arrow batch to the next.

    Only the named columns are sent to Python. Workers load a model once, and tell
    models apart by ``name`` and by their factory. A plan that is used twice scores
    twice: write the result first. There are as many tasks as ``rows`` has
    partitions: where rows are few but dear, repartition them first. A worker holds an
    Arrow batch, which Spark bounds by ``spark.sql.execution.arrow.maxBytesPerBatch``, and
    a batch of the scorer's. With ``arrow`` a scorer gets Arrow tables instead of pandas
    frames, which leaves nested arrays as they are.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    columns = list(dict.fromkeys([*keep, *inputs]))
    fields = [rows.schema[column] for column in keep]
    schema = T.StructType([*fields, T.StructField(output, T.StringType())])
    kept, used = list(keep), list(inputs)
    key = f"{name}:{code_digest(factory)}"

    def checked(answers: Sequence[str], count: int) -> list[str]:
        answers = list(answers)
        if len(answers) != count:
            raise ValueError(f"{len(answers)} answers for {count} rows")
        return answers

    def ends(sizes: Callable, asked: pd.DataFrame | pa.Table, count: int, last: bool) -> list[int]:
        held = [0] * count if max_bytes is None else sizes(asked)
        return batch_ends(held, batch_size, max_bytes, last)

    def run_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, factory)
        waiting: list[pa.Table] = []
        for batch in chain(batches, [None]):
            parts = waiting if batch is None else [*waiting, pa.Table.from_batches([batch])]
            if not parts:
                break
            sent = pa.concat_tables(parts)
            asked, texts, start = sent.select(used), [], 0
            for end in ends(_table_sizes, asked, sent.num_rows, batch is None):
                texts.extend(checked(scorer(asked.slice(start, end - start)), end - start))
                start = end
            waiting = [sent.slice(start)] if start < sent.num_rows else []
            answered = sent.slice(0, start).select(kept).append_column(output, pa.array(texts, pa.string()))
            yield from answered.combine_chunks().to_batches()
            if batch is None:
                break

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(key, factory)
        waiting: list[pd.DataFrame] = []
        for frame in chain(frames, [None]):
            parts = waiting if frame is None else [*waiting, frame]
            if not parts:
                break
            sent = _joined(parts)
            # The inputs are picked once: for each batch anew, a frame of many small ones would be copied as often.
            asked, texts, start = sent[used], [], 0
            for end in ends(_frame_sizes, asked, len(sent), frame is None):
                texts.extend(checked(scorer(asked.iloc[start:end]), end - start))
                start = end
            waiting = [sent.iloc[start:]] if start < len(sent) else []
            if start:
                scored = sent[kept].iloc[:start].copy()
                scored[output] = texts
                yield scored

    sent = rows.select(*columns)
    return sent.mapInArrow(run_arrow, schema) if arrow else sent.mapInPandas(run, schema)
