"""Scored rows kept in parts, so that only what is new or has changed is scored.

Beside its prediction every row keeps a digest of what the model was given. A run
compares the digests of its examples with those of the finished parts: examples
without a finished row are scored into parts of their own, and rows whose example
changed or is gone are left out of the result. A first run has nothing to compare
with and reads its examples once, while it scores them.

A part is written by one job and counts from the moment it is noted beside the
folder. What a lost job left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.operators.keys import KEY, keyed
from scorelane.session import is_complete, remove
from scorelane.sinks.results import folder_name

DIGEST = "input_digest"
FOLDER = "folder"
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)


def plain_columns(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that ``rows`` have and that are no audio or other nested values."""
    kinds = {field.name: field.dataType for field in rows.schema.fields}
    return [name for name in dict.fromkeys(names) if name in kinds and not isinstance(kinds[name], _NESTED)]


def input_digest(names: Sequence[str]) -> Column:
    """A hash of the columns, in which a null is unlike an absent neighbour."""
    return F.xxhash64(*names, *(F.col(name).isNull() for name in names))


def _note_path(path: str) -> str:
    return f"{path.rstrip('/')}.identity"


def read_note(spark: SparkSession, path: str) -> dict | None:
    """What is noted beside ``path``: its identity, its finished parts, and whether that is all."""
    noted = _note_path(path)
    return json.loads(spark.read.text(noted).first()["value"]) if is_complete(spark, noted) else None


def _write_note(spark: SparkSession, path: str, note: Mapping) -> None:
    line = spark.createDataFrame([(json.dumps(dict(note), sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(_note_path(path))


def _refuse(path: str, differing: Sequence[str]) -> None:
    raise ValueError(
        f"{path} was made by another build, which differs in {', '.join(differing)}; "
        "take another path, reuse=False to write it anew, or grow=True if only examples differ"
    )


def _read(spark: SparkSession, path: str, parts: Sequence[str], schema: T.StructType) -> DataFrame:
    found = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{part}" for part in parts))
    return found.select(*schema.names)


def _differences(asked: DataFrame, done: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """How many examples have no finished row, and how many finished rows no example."""
    sides = [
        keyed(rows, keys).select(KEY, DIGEST, F.lit(side).alias("side")) for side, rows in ((1, asked), (2, done))
    ]
    met = sides[0].unionByName(sides[1]).groupBy(KEY, DIGEST).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    found = met.agg(F.count_if(F.col("b") == 1).alias("new"), F.count_if(F.col("a") == 2).alias("stale")).first()
    return found["new"], found["stale"]


def _among(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    known = keyed(others, keys).select(KEY, DIGEST)
    return keyed(rows, keys).join(known, [KEY, DIGEST], how).select(*rows.columns)


def scored_parts(
    spark: SparkSession,
    path: str,
    examples: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    noticed: Sequence[str],
    by: Sequence[str],
    identity: Mapping[str, str],
    reuse: bool = True,
    grow: bool = False,
    parts: int = 1,
    accept: Callable[[], None] | None = None,
) -> DataFrame:
    """``build(examples)`` kept below ``path``, where only examples without a finished row are built.

    ``build`` passes ``input_digest`` on. ``noticed`` columns make the digest. Parts of
    another ``identity`` are refused, and so is a finished set of other examples, unless
    it may ``grow``. New examples are dealt to so many ``parts``, one job each: what a
    lost run had finished is found by the next one. ``accept`` may raise when all parts
    of a first run are written and before the last one counts.

    Rows are written as the tasks make them, and then gathered in few files, in a folder
    for each value of ``by``; names are in the rows, so null and empty ones stay apart.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    identity = dict(identity)
    note = read_note(spark, path) if reuse else None
    if note is not None:
        held = note.get("identity", {})
        differing = sorted(k for k in held.keys() | identity.keys() if held.get(k) != identity.get(k))
        if differing:
            _refuse(path, differing)
    else:
        remove(spark, path)
        note = {"identity": identity, "parts": [], "complete": False}
    asked = examples.withColumn(DIGEST, input_digest(plain_columns(examples, [*keys, *noticed])))
    schema = build(asked).schema
    pending, new, stale = asked, 1, 0
    if note["parts"]:
        done = _read(spark, path, note["parts"], schema)
        new, stale = _differences(asked, done, keys)
        if note["complete"] and (new or stale) and not grow:
            _refuse(path, ["examples"])
        pending = _among(asked, done, keys, "left_anti")
    first = not note["parts"]
    if new:
        _write_note(spark, path, {**note, "complete": False})
        for number in range(parts):
            part = pending
            if parts > 1:
                part = pending.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == number)
            name = f"part={uuid.uuid4().hex}"
            raw = f"{path.rstrip('/')}.raw/{name}"
            build(part).write.parquet(raw)
            if accept is not None and first and number == parts - 1:
                accept()
            # Written as the tasks come, so that nothing dear is done again for the shuffle's sake.
            named = folder_name(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)))
            rows = spark.read.schema(schema).parquet(raw).withColumn(FOLDER, named)
            rows.hint("rebalance", FOLDER).write.partitionBy(FOLDER).parquet(f"{path}/{name}")
            remove(spark, raw)
            note = {**note, "parts": [*note["parts"], name], "complete": number == parts - 1}
            _write_note(spark, path, note)
    found = _read(spark, path, note["parts"], schema)
    if stale:
        found = _among(found, asked, keys, "left_semi")
    return found.drop(DIGEST)
