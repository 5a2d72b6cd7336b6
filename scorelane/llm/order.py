"""Places of rows in sorted groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.llm.common import staged
from scorelane.session import few

PLACE = "place"
_PART = "__part"


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``place`` (0, 1, ...) in their group, sorted by ``order``; a stage.

    ``group`` has no nulls. Rows are dealt by ranges of (group, order), so a group of
    any size is spread over tasks if ``order`` tells its rows apart. Each task numbers
    its own rows as they stream by. Only groups that cross the edge of a range need
    more, and there are at most two of those per range.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(PLACE, T.LongType(), False)])
    at = rows.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(at))
            places, start = [], 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                seen = seen if value == last else 0
                places.extend(range(seen, seen + end - start))
                seen, start, last = seen + end - start, end, value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], schema=pa.schema(
                [*batch.schema, pa.field(PLACE, pa.int64(), False)]
            ))

    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = staged(dealt.mapInArrow(run, schema).withColumn(_PART, F.spark_partition_id()), name)
    edges = kept.groupBy(_PART).agg(F.min(group).alias("low"), F.max(group).alias("high"))
    edges = few(edges.select(F.explode(F.array("low", "high")).alias(group)).distinct(), f"{name}-edges")
    runs = kept.select(group, _PART).join(edges, group, "left_semi")
    runs = runs.groupBy(group, _PART).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = few(runs.select(group, _PART, F.sum("n").over(earlier).alias("__start")), f"{name}-starts")
    found = kept.join(starts, [group, _PART], "left")
    return found.withColumn(PLACE, F.col(PLACE) + F.coalesce("__start", F.lit(0))).select(*rows.columns, PLACE)
