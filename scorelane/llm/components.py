"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import attach_groups, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): nodes hang their neighbours on the smallest of them.

    The large star moves a node's larger neighbours, the small star its smaller ones
    and itself. Groups are summed up before they meet, and edges of a node that has
    very many stay where they are while the node's smallest neighbour comes to them.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = staged(
        both.groupBy("node").agg(
            F.least(F.min("other"), F.col("node")).alias("least"), F.count(F.lit(1)).alias("edges")
        ),
        "least",
    )
    moved = attach_groups(both, least, "node", "edges")
    if large:
        moved = moved.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Each linked ``node`` with its ``root``, the smallest node it can reach.

    ``links`` has columns ``a`` and ``b``. Every round is written to the shared
    folder; rounds grow with the logarithm of the number of nodes. Only counts and
    a checksum come to the driver.
    """
    edges = staged(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(edges)
    while True:
        edges = staged(_star(staged(_star(edges, True), "stars"), False), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A count and a checksum that tell two sets of edges apart."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)),
        ).first()
    )
