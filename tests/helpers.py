"""Small helpers for tests."""

import re

from pyspark.sql import functions as F


def column(spark, values, function, kind="string"):
    """The results of a column function over ``values``, in their order."""
    rows = [(i, value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, x {kind}")
    found = frame.select("i", function(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(found, key=lambda row: row.i)]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    """Shuffles in the plan before it runs."""
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin|Single)", plan_of(frame)))
