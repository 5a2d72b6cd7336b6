"""Nearest neighbours by stable projections, kd-trees and a chi-square test.

Vectors are lifted by one coordinate so that the largest inner product is the
smallest distance, and projected to a few dimensions by a Gaussian matrix. The
square of a projected distance over that of the true one has a chi-square
distribution. So a query looks at points in the order of their projected
distance, verifies them on the original vectors, and stops when the next one is so
far that a point as near as its k-th would have been met with the probability
asked for.

The projected space is cut into cells by a kd-tree fitted on a bounded sample;
every row is then put into its cell. A query asks its own cell first, and then, in
rounds, the next few cells in the order of their distance, as long as the test cannot
rule them out for the distance reached: each round brings that down for the next.
Cells are cut into shards of rows and blocks of queries, so no task holds a large
cell. In a shard, neighbouring queries go through the leaves of its kd-tree together:
the nearest leaves first, then those the test leaves over, as products of matrices. Of equal
vectors only the first ``k + 1`` can be among a query's answers; the others are
left out before that.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite numbers take no part, nor do rows without an id; of repeated
rows each is a candidate for the others; where there are fewer than ``k``
candidates all are given; ties go to the smaller id; a very long vector is one row, and
a task holds a shard of them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelane.llm.common import ROW_KEY, identified, staged, struct_of

NEAREST = 20
DIMENSIONS = 8
#: Probability with which a true neighbour is met before the search stops.
CONFIDENCE = 0.97
#: Rows that the cells are fitted on, the most cells, and rows of a cell about.
SAMPLE = 20_000
CELLS = 1024
CELL_ROWS = 8192
#: Rows of a shard and queries of a block about, which bound a task.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4096
LEAF = 64
#: Queries that go through a tree together, and leaves that they look at before the test.
TOGETHER = 64
FIRST = 16
#: Up to which of its cells, in order of distance, a query has asked after each round.
PROBES = (4, 16, 64, CELLS)
#: What a quick product may be off by.
ROUGH = 1e-9
SEED = 42

HITS = "query bigint, query_id bigint, vec_id bigint, score double, distance double"


def chi_square(x: float, dimensions: int) -> float:
    """The chi-square distribution function for an even number of dimensions."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dimensions // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_bound(confidence: float, dimensions: int) -> float:
    """The value that a chi-square variable stays below with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < confidence else (low, middle)
    return high


def projection(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length + 1, dimensions))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes all of them ``longest`` long."""
    left = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.hstack([vectors, left[:, None]])


def stretched(queries: np.ndarray, longest: float) -> np.ndarray:
    """Queries of length ``longest``, with nothing in the added coordinate."""
    size = np.sqrt((queries**2).sum(1))
    return np.hstack([queries * (longest / size)[:, None], np.zeros((len(queries), 1))])


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of ``points`` in leaves of at most ``size``, cut at the median of the widest side."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        held = open_.pop()
        spread = np.ptp(points[held], axis=0) if len(held) else np.zeros(1)
        if len(held) <= size or not spread.max() > 0:
            leaves.append(held)
            continue
        side = int(spread.argmax())
        order = held[np.argsort(points[held, side], kind="stable")]
        middle = len(order) // 2
        open_ += [order[:middle], order[middle:]]
    return leaves


def kd_cuts(points: np.ndarray, cells: int) -> list:
    """A tree of (side, value, left, right) whose leaves are cell numbers."""
    made = [0]

    def cut(held: np.ndarray, wanted: int):
        spread = np.ptp(held, axis=0) if len(held) > 1 else np.zeros(1)
        if wanted > 1 and spread.max() > 0:
            side = int(spread.argmax())
            value = float(np.median(held[:, side]))
            below = held[:, side] < value
            if below.any() and not below.all():
                return (side, value, cut(held[below], wanted // 2), cut(held[~below], wanted - wanted // 2))
        made[0] += 1
        return made[0] - 1

    return cut(points, cells)


def cells_of(tree, points: np.ndarray) -> np.ndarray:
    found = np.zeros(len(points), np.int32)
    open_ = [(tree, np.arange(len(points)))]
    while open_:
        at, held = open_.pop()
        if isinstance(at, tuple):
            below = points[held, at[0]] < at[1]
            open_ += [(at[2], held[below]), (at[3], held[~below])]
        else:
            found[held] = at
    return found


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return (away**2).sum(1)


class Tree:
    """A kd-tree over projected points whose leaves are met nearest first."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves = kd_leaves(points, leaf)
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def nearest(self, queries, projected, own, reach, vectors, ids, rows, longest, k, bound):
        """For each query its (scores, ids) of the nearest rows, verified until the test holds.

        ``reach`` has squared distances within which ``k`` rows are known already.
        """
        self.looked = 0
        place = {row: at for at, row in enumerate(rows.tolist())}
        selves = np.array([place.get(row, -1) for row in own.tolist()], np.int64)
        home = np.argmin(self._away(projected), axis=1) if len(self.leaves) > 1 else np.zeros(len(queries))
        order = np.argsort(home, kind="stable")
        found = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
        for start in range(0, len(order), TOGETHER):
            chosen = order[start : start + TOGETHER]
            away = self._away(projected[chosen])
            leaves = np.argsort(away.min(0), kind="stable")
            reached = reach[chosen].copy()
            for part in (leaves[:FIRST], leaves[FIRST:]):
                part = part[(away[:, part] <= bound * reached[:, None]).any(0)]
                if not len(part):
                    continue
                held = np.concatenate([self.leaves[leaf] for leaf in part])
                self.looked += len(held) * len(chosen)
                rough = vectors[held] @ queries[chosen].T
                spot = np.full(len(vectors), -1)
                spot[held] = np.arange(len(held))
                for column, q in enumerate(chosen.tolist()):
                    if selves[q] >= 0 and spot[selves[q]] >= 0:
                        rough[spot[selves[q]], column] = -math.inf
                    found[q] = self._best(found[q], rough[:, column], held, queries[q], vectors, ids, longest, k)
                    scores = found[q][0]
                    if len(scores) == k:
                        size = math.sqrt(queries[q] @ queries[q])
                        reached[column] = min(
                            reached[column], max(2 * longest**2 - 2 * longest / size * scores[-1], 0.0)
                        )
        return found

    def _away(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to the leaves' boxes."""
        found = np.zeros((len(points), len(self.leaves)))
        for side in range(points.shape[1]):
            at = points[:, side, None]
            found += np.maximum(np.maximum(self.low[None, :, side] - at, at - self.high[None, :, side]), 0) ** 2
        return found

    @staticmethod
    def _best(known, rough, held, query, vectors, ids, longest, k):
        """The best ``k`` of what is known and of the rows ``held``, whose products are about ``rough``."""
        scores, found = known
        least = scores[-1] if len(scores) == k else -math.inf
        if len(rough) > k:
            least = max(least, np.partition(rough, -k)[-k])
        near = held[(rough >= least - ROUGH * longest * math.sqrt(query @ query)) & (rough > -math.inf)]
        # A sum by row is the same for equal vectors, wherever they stand.
        scores = np.concatenate([scores, (vectors[near] * query).sum(1)])
        found = np.concatenate([found, ids[near]])
        best = np.lexsort((found, -scores))[:k]
        return scores[best], found[best]


def usable(vector: Column) -> Column:
    """Whether a vector can take part, its length aside."""
    fit = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(fit & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)


def _first_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """At most ``k + 1`` rows of each vector, those with the smallest ids."""
    same = [F.xxhash64("vector"), F.hash("vector")]
    part = F.pmod(F.xxhash64(ROW_KEY), F.lit(64))
    for keys in ([*same, part], same):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id", ROW_KEY))
        rows = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    return rows


def search(
    vectors: DataFrame,
    is_query: Column | str,
    k: int = NEAREST,
    dimensions: int = DIMENSIONS,
    confidence: float = CONFIDENCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Each query's ``k`` nearest rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` says which of its rows ask.
    """
    rows = identified(vectors.select("vec_id", "embedding"), "vectors").select(
        ROW_KEY, F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy(F.size("vector").alias("length")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(size).alias("longest")
    )
    most = sizes.orderBy(F.desc("rows"), "length").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, count, longest = most["length"], most["rows"], math.sqrt(most["longest"])
    rows = rows.where(F.size("vector") == length)
    matrix = projection(length, dimensions)
    bound = chi_square_bound(confidence, dimensions)

    chosen = rows.orderBy(F.xxhash64(ROW_KEY)).limit(SAMPLE).select("vector").toArrow()
    sample = _matrix(chosen.column(0).combine_chunks(), length)
    cuts = kd_cuts(lifted(sample, longest) @ matrix, min(CELLS, -(-count // cell_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = _matrix(batch.column(2), length)
                points = lifted(held, longest) @ matrix
                asked = stretched(held, longest) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array(cells_of(cuts, points)),
                        pa.array(list(points), pa.list_(pa.float64())),
                        pa.array(cells_of(cuts, asked)),
                        pa.array(list(asked), pa.list_(pa.float64())),
                    ],
                    names=[ROW_KEY, "vec_id", "vector", "cell", "point", "home", "asked"],
                )

    placed = f"{ROW_KEY} bigint, vec_id bigint, vector array<double>, cell int, point array<double>"
    whole = struct_of(f"{placed}, home int, asked array<double>")
    all_rows = staged(rows.mapInArrow(place, whole), "placed")
    candidates = staged(_first_of_equals(all_rows.drop("home", "asked"), k), "candidates")
    queries = all_rows.where(is_query).select(
        F.col(ROW_KEY).alias("query"), F.col("vec_id").alias("query_id"), "vector", "home", "asked"
    )

    # A row per cell, and there are at most CELLS: its rows, and the box of its points.
    sides = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(dimensions)]
    boxes = candidates.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *sides).toPandas()
    numbers = boxes["cell"].to_numpy()
    low = boxes[[f"l{i}" for i in range(dimensions)]].to_numpy()
    high = boxes[[f"h{i}" for i in range(dimensions)]].to_numpy()
    shards = candidates.sparkSession.createDataFrame(
        [(int(c), max(1, -(-int(n) // SHARD_ROWS))) for c, n in zip(numbers, boxes["rows"], strict=True)],
        "cell int, shards int",
    )

    def ask(asking: DataFrame) -> DataFrame:
        """Hits of ``asking`` (queries with ``cell`` and ``reach``) in their cells."""
        blocks = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
        plan = F.broadcast(staged(shards.join(blocks, "cell"), "plan"))
        row_part = F.pmod(F.xxhash64(ROW_KEY), F.col("shards")).cast("int")
        query_part = F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")
        dealt = candidates.join(plan, "cell").select(
            "cell", row_part.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            ROW_KEY, "vec_id", "vector", "point",
        )
        asked = asking.join(plan, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), query_part.alias("block"),
            "query", "query_id", "vector", "asked", "reach",
        )

        def meet(held: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple] = []
            if len(held) and len(questions):
                matrix_ = np.stack(held["vector"].to_numpy())
                tree = Tree(np.stack(held["point"].to_numpy()))
                ids, rows_ = held["vec_id"].to_numpy(), held[ROW_KEY].to_numpy()
                queries_ = np.stack(questions["vector"].to_numpy())
                hits = tree.nearest(
                    queries_, np.stack(questions["asked"].to_numpy()), questions["query"].to_numpy(),
                    questions["reach"].to_numpy(), matrix_, ids, rows_, longest, k, bound,
                )
                asking_ids = zip(questions["query"].tolist(), questions["query_id"].tolist(), strict=True)
                for (query, query_id), vector, (scores, near) in zip(asking_ids, queries_, hits, strict=True):
                    scale = longest / math.sqrt(vector @ vector)
                    away = np.maximum(2 * longest**2 - 2 * scale * scores, 0.0)
                    found.extend(
                        (query, query_id, i, score, d)
                        for i, score, d in zip(near.tolist(), scores.tolist(), away.tolist(), strict=True)
                    )
            return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score", "distance"])

        keys = ["cell", "shard", "block"]
        hits = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, struct_of(HITS))
        return hits

    nearest = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    everywhere = F.lit(float("inf"))
    hits = staged(
        ranked(ask(queries.withColumn("cell", F.col("home")).withColumn("reach", everywhere))), "home-hits"
    )
    sent = struct_of(
        "query bigint, query_id bigint, vector array<double>, home int, asked array<double>, reach double, cell int"
    )

    def routing(start: int, stop: int):
        """Queries with each of the cells that are ``start`` to ``stop`` in the order of distance, and in reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    points = _matrix(part.column(4), dimensions)
                    homes = part.column(3).to_numpy()
                    reach = part.column(5).to_numpy()
                    away = np.stack([box_distance(low, high, point) for point in points])
                    away[homes[:, None] == numbers[None, :]] = math.inf
                    order = np.argsort(away, axis=1, kind="stable")[:, start:stop]
                    near = np.take_along_axis(away, order, axis=1)
                    which, place = np.nonzero((near <= bound * reach[:, None]) & np.isfinite(near))
                    if len(which):
                        again = part.take(pa.array(which))
                        cells = numbers[order[which, place]].astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [*again.columns, pa.array(cells)], names=[*again.schema.names, "cell"]
                        )

        return run

    start = 0
    for stop in PROBES:
        if start >= len(numbers) - 1:
            break
        reached = hits.where(F.col("rank") == k).select("query", F.col("distance").alias("reach"))
        left = queries.join(reached, "query", "left").withColumn("reach", F.coalesce("reach", everywhere))
        asking = left.select("query", "query_id", "vector", "home", "asked", "reach")
        routed = staged(asking.mapInArrow(routing(start, stop), sent), "routed")
        # Cells further away are in no one's reach either.
        if routed.isEmpty():
            break
        hits = staged(ranked(hits.drop("rank").unionByName(ask(routed))), "hits")
        start = stop
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
