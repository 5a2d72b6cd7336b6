import pytest
from helpers import exchanges
from pyspark.sql import functions as F

from scorelane.operators.hints import (
    attach_hints,
    hint_conflicts,
    hint_match_rate,
    hints_from_results,
    settled_hints,
    without_hint,
    zip_results,
)
from scorelane.operators.select import (
    choose_samples,
    missing_from,
    require_matched,
    split_usable,
    unmatched_counts,
)
from scorelane.sinks.results import write_bucketed
from scorelane.sources.hints import hint_rows, read_hint_maps

KEYS = "dataset string, split string, sample_id long"


def responses(spark, n=6):
    return spark.createDataFrame([("a", "dev", i) for i in range(n)], KEYS)


def test_hints_of_another_split_are_not_joined(spark):
    hints = spark.createDataFrame([("a", "train", 0, "1,0.65"), ("a", "dev", 1, "0,0.70")], f"{KEYS}, hint string")
    found = attach_hints(responses(spark, 3), hints).orderBy("sample_id").collect()
    assert [r.hint for r in found] == ["No binary prediction", "0,0.70", "No binary prediction"]
    assert [r.sample_id for r in without_hint(responses(spark, 3), hints).orderBy("sample_id").collect()] == [0, 2]


def test_strict_hints_need_a_comma(spark):
    rows = spark.createDataFrame(
        [("a", "dev", 0, " 1,0.65\n"), ("a", "dev", 1, "4.5"), ("a", "dev", 2, None)], f"{KEYS}, prediction string"
    )
    assert [(r.sample_id, r.hint) for r in hints_from_results(rows).collect()] == [(0, "1,0.65")]
    loose = hints_from_results(rows, strict=False).orderBy("sample_id").collect()
    assert [r.hint for r in loose] == [" 1,0.65\n", "4.5", None]
    usable, rejected = split_usable(rows)
    assert usable.count() + rejected.count() == 3


def test_all_own_predictions_are_found(spark):
    rows = responses(spark, 50).withColumn("prediction", F.lit("1,0.65"))
    found = attach_hints(responses(spark, 50), hints_from_results(rows))
    assert found.where("hint = '1,0.65'").count() == 50


def test_results_must_fit(spark):
    left = responses(spark, 3).withColumn("prediction", F.lit("x"))
    right = responses(spark, 3).withColumn("label", F.lit(None).cast("string"))
    assert zip_results(left, right).count() == 3
    with pytest.raises(Exception, match="do not match"):
        zip_results(left, responses(spark, 4).withColumn("label", F.lit("y"))).collect()
    require_matched(left, right, ["sample_id"])
    with pytest.raises(ValueError, match="right_only"):
        require_matched(left, responses(spark, 4), ["sample_id"])


def test_keys_are_counted_once(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert tuple(unmatched_counts(left, right, ["k"]).first()) == (1, 1, 1)


def test_samples_by_index_or_speaker(spark):
    rows = responses(spark).withColumn("speaker_id", F.col("sample_id") % 2)
    indices = spark.createDataFrame([(1,), (1,), (99,)], "sample_id long")
    assert [r.sample_id for r in choose_samples(rows, indices=indices).collect()] == [1]
    assert [r.sample_id for r in missing_from(rows, indices, "sample_id").collect()] == [99]
    speakers = spark.createDataFrame([(1,), (1,)], "speaker_id long")
    assert choose_samples(rows, speakers=speakers).count() == 3
    with pytest.raises(ValueError):
        choose_samples(rows, indices=indices, speakers=speakers)
    with pytest.raises(ValueError):
        choose_samples(rows)
    with pytest.raises(ValueError, match="speaker_id"):
        choose_samples(rows.drop("speaker_id"), speakers=speakers)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = ["dataset", "split", "sample_id"]
        hints = responses(spark).withColumn("hint", F.lit("1,0.65"))
        write_bucketed(responses(spark), "resp", str(tmp_path / "r"), 8, keys)
        write_bucketed(hints, "hints", str(tmp_path / "h"), 8, keys)
        hints.write.parquet(str(tmp_path / "plain"))
        joined = attach_hints(spark.table("resp"), spark.table("hints"))
        assert exchanges(joined) == 0
        # responses stay where they are also if only they are bucketed
        plain = attach_hints(spark.table("resp"), spark.read.parquet(str(tmp_path / "plain")))
        assert exchanges(plain) == 1
        for found in (joined, plain):
            assert found.where("hint = '1,0.65'").count() == 6
    finally:
        spark.sql("DROP TABLE IF EXISTS resp")
        spark.sql("DROP TABLE IF EXISTS hints")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_names_and_repeats(spark):
    """Null is a name like others, and a repeated hint does not repeat the response."""
    rows = spark.createDataFrame([(None, "dev", 0), ("a", None, 0), ("a", "dev", 0), (None, "dev", 1)], KEYS)
    hints = spark.createDataFrame(
        [(None, "dev", 0, "old", 1), (None, "dev", 0, "new", 2), (None, "dev", 0, None, 2), ("a", None, 0, "x", 1)],
        f"{KEYS}, hint string, run int",
    )
    found = attach_hints(rows, hints, default="none", order=["run"]).collect()
    assert {(r.dataset, r.split, r.sample_id): r.hint for r in found} == {
        (None, "dev", 0): "new", ("a", None, 0): "x", ("a", "dev", 0): "none", (None, "dev", 1): "none"
    }
    assert len(found) == 4 and attach_hints(rows, hints, default="none").count() == 4
    conflict = hint_conflicts(hints).collect()
    assert [(r.sample_id, r.dataset, r.split, r.hints, r.least, r.greatest) for r in conflict] == [
        (0, None, "dev", 3, "new", "old")
    ]
    assert without_hint(rows, hints).count() == 2
    rates = {(r.dataset, r.split): r.rate for r in hint_match_rate(rows, hints).collect()}
    assert rates == {(None, "dev"): 0.5, ("a", None): 1.0, ("a", "dev"): 0.0}
    left, right = rows.withColumn("prediction", F.lit("p")), rows.withColumn("label", F.lit("l"))
    assert zip_results(left, right).count() == 4
    assert tuple(unmatched_counts(rows, rows, ["dataset", "split", "sample_id"]).first()) == (4, 0, 0)


def test_the_last_entry_of_an_id_counts(spark, tmp_path):
    """A map that repeats an id, as a text may: the place in the map decides."""
    path = tmp_path / "map.json"
    path.write_text('{"dataset": "a", "split": "dev", "binary_predictions": {"7": "z first", "8": "b", "7": "a last"}}')
    hints = hint_rows(read_hint_maps(spark, str(path)), "dataset", "split", place="place")
    assert settled_hints(hints, order=["place"]).where("sample_id = 7").first().hint == "a last"
    rows = spark.createDataFrame([("a", "dev", 7), ("a", "dev", 8)], KEYS)
    found = attach_hints(rows, hints, order=["place"]).collect()
    assert {r.sample_id: r.hint for r in found} == {7: "a last", 8: "b"}
