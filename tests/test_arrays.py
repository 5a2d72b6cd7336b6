import random

import pytest
from helpers import column
from pyspark.sql import functions as F

from scorelane.functions.arrays import (
    attention_mask,
    block_sizes,
    cut_at_sequences,
    cut_generated,
    drop_pad,
    evaluation_labels,
    length_mask,
    pad,
    pad_block,
    pad_frames,
    pad_ids,
    training_ids,
    training_labels,
)
from scorelane.operators.batches import collate, with_batch_width

LONGS = "array<long>"


def test_padding_on_either_side(spark):
    ids = [[1], [2, 3, 4], [5, 6]]
    left = column(spark, ids, lambda x: pad_ids(x, F.lit(3)), LONGS)
    assert left == [[0, 0, 1], [2, 3, 4], [0, 5, 6]]
    right = column(spark, ids, lambda x: pad_ids(x, F.lit(3), "right"), LONGS)
    assert right == [[1, 0, 0], [2, 3, 4], [5, 6, 0]]
    with pytest.raises(ValueError):
        pad(F.lit(1), F.lit(1), F.lit(0), "middle")


def test_masks(spark):
    assert column(spark, [[0, 0, 7], [1, 0, 2]], attention_mask, LONGS) == [[0, 0, 1], [1, 0, 1]]
    assert column(spark, [2, 0, 3], lambda n: length_mask(n, F.lit(3)), "int") == [
        [True, True, False], [False] * 3, [True] * 3,
    ]
    assert column(spark, [[0, 5, 0, 6], []], drop_pad, LONGS) == [[5, 6], []]


def test_frames_are_padded_in_both_directions(spark):
    frames = [[[1.0], [2.0, 3.0]], []]
    found = column(spark, frames, lambda x: pad_frames(x, F.lit(3), F.lit(2)), "array<array<float>>")
    assert found == [[[1.0, 0.0], [2.0, 3.0], [0.0, 0.0]], [[0.0, 0.0]] * 3]


def test_labels_ignore_the_prompt(spark):
    rows = spark.createDataFrame([([1, 2, 3], [8, 9]), ([1], [])], f"p {LONGS}, a {LONGS}")
    p, a = F.col("p"), F.col("a")
    found = rows.select(training_ids(p, a), training_labels(p, a), evaluation_labels(p, a)).collect()
    assert [tuple(r) for r in found] == [
        ([1, 2, 3, 8, 9], [-100, -100, -100, 8, 9], [8, 9]),
        ([1], [-100], [-100]),
    ]


def test_generated_ids_end_at_the_first_stop(spark):
    cases = [
        ([1, 2, 7, 9, 5], 2, [7]),
        ([1, 9, 7, 8], 2, [7, 8]),
        ([1, 2, 9, 4], 2, []),
        ([1, 2], 2, []),
        ([1, 2, 3, 13, 9], 1, [2, 3]),
    ]
    rows = spark.createDataFrame([(i, ids, n) for i, (ids, n, _) in enumerate(cases)], f"i int, ids {LONGS}, n int")
    found = rows.select("i", cut_generated(F.col("ids"), F.col("n"), (9, 13)).alias("cut")).orderBy("i").collect()
    assert [r.cut for r in found] == [cut for _, _, cut in cases]


def samples(spark):
    rows = [
        ("a", 0, 10, [1, 2], [5], [[1.0, 1.0]]),
        ("a", 1, 11, [3], [6, 7], [[2.0], [2.0, 2.0]]),
        ("a", 2, 12, [4, 0, 4], [8], []),
        ("b", 0, 13, [9], [9], [[3.0]]),
    ]
    return spark.createDataFrame(
        rows,
        f"dataset string, position long, sample_id long, input_ids {LONGS}, labels {LONGS}, "
        "frames array<array<float>>",
    ).withColumn("total", F.when(F.col("dataset") == "a", 3).otherwise(1).cast("long"))


def test_whole_batches(spark):
    found = {(r.dataset, r.batch): r for r in collate(samples(spark), 2, ["dataset"]).collect()}
    assert set(found) == {("a", 0), ("a", 1), ("b", 0)}
    first = found["a", 0]
    assert first.sample_ids == [10, 11]
    assert first.input_ids == [[1, 2], [0, 3]]
    assert first.attention_mask == [[1, 1], [0, 1]]
    assert first.labels == [[0, 5], [6, 7]]
    assert first.input_audio == [[[1.0, 1.0], [0.0, 0.0]], [[2.0, 0.0], [2.0, 2.0]]]
    assert first.audio_sizes == [1, 2]
    assert first.audio_mask == [[True, False], [True, True]]
    assert found["a", 1].audio_mask is None and found["a", 1].attention_mask == [[1, 0, 1]]


def test_short_batches_are_left_out_on_request(spark):
    found = collate(samples(spark), 2, ["dataset"], drop_last=True).collect()
    assert [(r.dataset, r.batch) for r in found] == [("a", 0)]


def test_every_row_of_a_batch_has_its_width(spark):
    wide = with_batch_width(samples(spark), "input_ids", 2, ["dataset"]).collect()
    assert {r.sample_id: (r.batch, r.width, r.batch_rows) for r in wide} == {
        10: (0, 2, 2), 11: (0, 2, 2), 12: (1, 3, 1), 13: (0, 1, 1),
    }


def cut(spark, rows, stops, **how):
    frame = spark.createDataFrame([(i, p, ids) for i, (p, ids) in enumerate(rows)], "i int, p int, ids array<bigint>")
    found = frame.select("i", cut_at_sequences(F.col("ids"), F.col("p"), stops, **how).alias("kept")).collect()
    return [row.kept for row in sorted(found, key=lambda row: row.i)]


def by_rule(ids, stops):
    """Up to the stop that is complete first; of several the longest."""
    for end in range(1, len(ids) + 1):
        held = [len(s) for s in stops if len(s) <= end and ids[end - len(s) : end] == list(s)]
        if held:
            return ids[: end - max(held)]
    return ids


def test_stop_sequences(spark):
    stops = [(1, 2, 1, 3), (2, 1, 1), (3, 3), (4,)]
    chance = random.Random(7)
    rows = [(0, [chance.randrange(1, 6) for _ in range(chance.randrange(12))]) for _ in range(300)]
    assert cut(spark, rows, stops) == [by_rule(ids, stops) for _, ids in rows]
    # overlapping beginnings: the automaton falls back without reading an id again
    assert cut(spark, [(0, [1, 2, 1, 2, 1, 3, 5])], stops) == [[1, 2]]
    # a stop neither begins in the prompt nor in an unknown id
    assert cut(spark, [(2, [3, 3, 3, 5]), (1, [9, None, 2**40, 4]), (5, [4]), (0, [])], stops) == [[3, 5], [None, 2**40], [], []]


def test_padded_stops(spark):
    assert cut(spark, [(0, [5, 0, 7, 8])], [(7, 0), (0, 7, 8)]) == [[5, 0]]
    assert cut(spark, [(0, [5, 0, 7, 8])], [(0, 7)], pad_id=None) == [[5]]
    for stops in ([], [()], [(0, 0)]):
        with pytest.raises(ValueError, match="stop"):
            cut(spark, [(0, [1])], stops)


def test_blocks_of_any_rank(spark):
    four = [[[[1], [2, 3]]], [[[4]], []]]
    frame = spark.createDataFrame([(four,), ([],), ([[]],)], "b array<array<array<array<bigint>>>>")
    sizes = block_sizes(F.col("b"), 4)
    assert [tuple(r) for r in frame.select(*sizes).collect()] == [(2, 2, 2, 2), (0, 0, 0, 0), (1, 0, 0, 0)]
    zero = F.lit(0).cast("bigint")
    padded = pad_block(F.col("b"), [F.lit(2), F.lit(2), F.lit(2), F.lit(3)], zero)
    found = [r[0] for r in frame.select(padded).collect()]
    whole = [[[[0] * 3] * 2] * 2] * 2
    assert found[1] == found[2] == whole
    assert found[0][0][0] == [[1, 0, 0], [2, 3, 0]] and found[0][1] == [[[4, 0, 0], [0, 0, 0]], [[0] * 3] * 2]


def test_batch_width_of_sizes(spark):
    rows = spark.createDataFrame([(0, 3), (1, 5), (2, 1)], "position long, own int")
    found = with_batch_width(rows, "own", 2).orderBy("position").collect()
    assert [(r.batch, r.width, r.batch_rows) for r in found] == [(0, 5, 2), (0, 5, 2), (1, 1, 1)]
