import random

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from scorelane.operators.position import (
    batch_number,
    drop_short_batch,
    first_rows,
    ordered_position,
    shard_number,
    take_first,
    with_position,
)


def keyed(spark, rows):
    return spark.createDataFrame(rows, "dataset string, id long")


def expected_positions(rows):
    found = {}
    for name in {name for name, _ in rows}:
        ids = sorted(i for d, i in rows if d == name)
        found.update({(name, i): (p, len(ids)) for p, i in enumerate(ids)})
    return found


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_positions_follow_the_key(spark, bits):
    """Sparse and negative keys, a hot dataset, and rows without dataset."""
    rng = random.Random(2)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + list(range(200))
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), i) for i in ids]
    placed = with_position(keyed(spark, rows), "id", ["dataset"], bits)
    found = {(r.dataset, r.id): (r.position, r.total) for r in placed.collect()}
    assert found == expected_positions(rows)


def test_positions_without_datasets(spark):
    ids = [5, 900, 2, 77, 10**12]
    placed = with_position(keyed(spark, [("a", i) for i in ids]), "id", bucket_bits=4)
    assert [r.id for r in placed.orderBy("position").collect()] == sorted(ids)


def test_numbering_and_join_share_one_shuffle(spark):
    """With sort-merge joins throughout, the wide side is still exchanged once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = keyed(spark, [("a", 1)]).withColumn("wide", F.lit("payload"))
        placed = with_position(rows, "id", ["dataset"])
        lines = plan_of(placed).split("\n")
        joined = next(i for i, line in enumerate(lines) if "SortMergeJoin [_bucket" in line)
        numbered = next(i for i, line in enumerate(lines) if "Window [row_number" in line)
        assert joined < numbered
        assert not [line for line in lines[joined:numbered] if "Exchange" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("n, shards", [(10, 3), (9, 3), (2, 5), (1, 1), (100, 7)])
def test_shards_are_whole_and_balanced(spark, n, shards):
    placed = with_position(keyed(spark, [("a", i * 3) for i in range(n)]), "id", ["dataset"])
    position, total = F.col("position"), F.col("total")
    for mode in ("contiguous", "modulo"):
        cut = placed.select(position, shard_number(position, shards, mode, total).alias("shard"))
        found = sorted((r.position, r.shard) for r in cut.collect())
        sizes = [sum(s == i for _, s in found) for i in range(shards)]
        assert len(found) == n and max(sizes) - min(sizes) <= 1
        if mode == "contiguous":
            in_order = [s for _, s in found]
            assert in_order == sorted(in_order) and sizes == sorted(sizes, reverse=True)


def test_a_limit_comes_before_shards(spark):
    placed = with_position(keyed(spark, [("a", i) for i in range(20)]), "id", ["dataset"])
    limited = first_rows(placed, 7)
    cut = limited.select(shard_number(F.col("position"), 2, "modulo").alias("s")).groupBy("s").count()
    assert {r.s: r["count"] for r in cut.collect()} == {0: 4, 1: 3}


def test_short_batches_can_be_left_out(spark):
    rows = [("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [("c", i) for i in range(8)]
    placed = with_position(keyed(spark, rows), "id", ["dataset"])
    kept = drop_short_batch(placed, 4).groupBy("dataset", batch_number(F.col("position"), 4)).count()
    assert sorted((r.dataset, r["count"]) for r in kept.collect()) == [("a", 4), ("a", 4), ("c", 4), ("c", 4)]


def test_bad_shards_are_refused(spark):
    with pytest.raises(ValueError):
        shard_number(F.lit(1), 0)
    with pytest.raises(ValueError):
        shard_number(F.lit(1), 2, "other")


@pytest.mark.parametrize("n", [1, 3, 199, 200, 201, 5000])
def test_the_first_rows_of_each_dataset(spark, n):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), i * 7) for i in rng.sample(range(900), 300)]
    expected = {key: p for key, (p, _) in expected_positions(rows).items() if p < n}
    found = take_first(keyed(spark, rows).repartition(6), "id", n, ["dataset"])
    assert {(r.dataset, r.id): r.position for r in found.collect()} == expected


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_there_is_one_way_for_every_number(spark, n):
    rows = [("a", i * 3) for i in range(1200)] + [("b", i) for i in range(1000)]
    found = take_first(keyed(spark, rows), "id", n, ["dataset"]).collect()
    assert {(r.dataset, r.position) for r in found} == {
        *(("a", p) for p in range(n)), *(("b", p) for p in range(min(n, 1000)))
    }
    with pytest.raises(ValueError, match="integer key"):
        take_first(keyed(spark, rows).withColumn("id", F.col("id").cast("string")), "id", n, ["dataset"])


def test_buckets_behind_the_first_rows_are_not_numbered(spark):
    rows = spark.range(5000).select(F.lit("a").alias("dataset"), "id")
    kept = with_position(rows, "id", ["dataset"], bucket_bits=4, first=20)
    assert sorted(r.position for r in kept.collect()) == list(range(20))
    plans = [plan_of(take_first(rows, "id", n, ["dataset"])) for n in (10, 4000)]
    assert plans[0].count("Window") == plans[1].count("Window")
    assert "_start#" in plans[0] and "< 10)" in plans[0]


def test_the_first_rows_overall(spark):
    rows = keyed(spark, [("a", i) for i in (5, 3, 9, 1)])
    assert [(r.id, r.position) for r in take_first(rows, "id", 2).orderBy("id").collect()] == [(1, 0), (3, 1)]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_positions_by_any_key(spark, partitions):
    """Texts, numbers and nulls as keys, a large dataset over several ranges, and a null dataset."""
    rows = [("a", f"k{i * 7919 % 1009:04}", i) for i in range(3000)] + [(None, None, i) for i in range(5)]
    rows += [("b", name, i) for i, name in enumerate(["é", "z", None, "Z", "", "z"])]
    frame = spark.createDataFrame(rows, "dataset string, name string, id long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = ordered_position(frame, ["name", "id"], ["dataset"]).collect()
        overall = ordered_position(frame.withColumn("half", F.col("id") / 2), ["half", "dataset", "name"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for dataset in ("a", "b", None):
        held = sorted((r.name is not None, (r.name or "").encode(), r.id) for r in found if r.dataset == dataset)
        placed = {(r.name, r.id): (r.position, r.total) for r in found if r.dataset == dataset}
        names = {(key.decode() if some else None, i): at for at, (some, key, i) in enumerate(held)}
        assert placed == {key: (at, len(held)) for key, at in names.items()}
    assert sorted(r.position for r in overall) == list(range(len(rows)))
    assert [r.half for r in sorted(overall, key=lambda r: r.position)] == sorted(r[2] / 2 for r in rows)


def test_no_rows_have_no_position(spark):
    assert ordered_position(spark.createDataFrame([], "g string, k string"), ["k"], ["g"]).count() == 0


def test_rows_of_one_dataset_are_numbered_by_several_tasks(spark):
    """Neighbouring keys do not all meet in one task, where wide rows would need as much memory as there are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = with_position(spark.range(80_000), "id").withColumn("task", F.spark_partition_id())
        counts = [r["count"] for r in placed.groupBy("task").count().collect()]
        assert sum(counts) == 80_000 and max(counts) < 40_000
        assert placed.where(F.col("position") != F.col("id")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
