"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scorelane")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to the machine's own temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scorelane-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/scorelane/{name}-{uuid.uuid4().hex}"


def few(frame: DataFrame, name: str = "few", rows: int = 100_000) -> DataFrame:
    """An aggregate that is small as a rule: written, read back, and broadcast if it is small indeed.

    Spark takes an aggregate to be as large as its input, and would shuffle what it
    is joined to. Of the written table it knows the size, and so do we.
    """
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    kept = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return F.broadcast(kept) if kept.count() <= rows else kept


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """That two tables agree in ``keys``, where null is a value like any other."""
    return reduce(and_, (left[key].eqNullSafe(right[key]) for key in keys))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system its scheme names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return jvm_path.getFileSystem(conf).exists(jvm_path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has written all of ``path``."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``, if anything does; for folders of our own making."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    jvm_path.getFileSystem(conf).delete(jvm_path, True)
