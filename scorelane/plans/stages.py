"""Stages kept on disk, so that a job can go on where it was lost."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.session import is_complete


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> str:
    """A number of rows and an order-free sum of their hashes over ``columns``."""
    hashed = F.xxhash64(*columns).cast("decimal(38,0)")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).alias("h")).first()
    return f"{found['n']}:{found['h']}"


def _same_build(spark: SparkSession, path: str, identity: Mapping[str, str]) -> None:
    """Fail unless the stage at ``path`` was made by this build from this input."""
    noted = f"{path.rstrip('/')}.identity"
    known = spark.read.text(noted).first()["value"] if is_complete(spark, noted) else "{}"
    known = json.loads(known)
    other = sorted(k for k in known.keys() | identity.keys() if known.get(k) != identity.get(k))
    if other:
        raise ValueError(
            f"{path} was made by another build, which differs in {', '.join(other)}; "
            "take another path, or reuse=False to write it anew"
        )


def _note(spark: SparkSession, path: str, identity: Mapping[str, str]) -> None:
    line = spark.createDataFrame([(json.dumps(dict(identity), sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.identity")


def stage(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partitions: Sequence[str] = (),
    reuse: bool = True,
    identity: Mapping[str, str] | None = None,
    gather: bool = False,
) -> DataFrame:
    """The table at ``path``, built and written there unless it is already complete.

    ``identity`` says what the stage is made by and from. It is noted beside the
    table, and a complete table with another one is refused, not taken.

    With ``gather`` the rows are written twice: as the tasks make them, and then
    in few files per folder, which is for rows that are narrow and dear.

    Reading it back cuts the lineage at a place every executor can reach, and
    keeps an expensive scorer from running twice. Tasks write what they have
    built without a shuffle, so a lost executor costs only its unfinished tasks.
    A half-written folder has no success marker and is built again.
    """
    frame = build()
    identity = dict(identity or {})
    if reuse and is_complete(spark, path):
        _same_build(spark, path, identity)
    else:
        # No build has this identity, so what is half done is never taken for either's.
        _note(spark, path, {"unfinished": uuid.uuid4().hex})
        schema, rows = frame.schema, frame
        if gather:
            # Written as the tasks come, so that nothing dear is done again for the shuffle's sake.
            parts = f"{path.rstrip('/')}.parts"
            frame.write.mode("overwrite").parquet(parts)
            rows = spark.read.schema(schema).parquet(parts).hint("rebalance", *partitions)
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)
        _note(spark, path, identity)
    return spark.read.schema(frame.schema).parquet(path)
