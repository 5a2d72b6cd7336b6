import pytest
from helpers import exchanges, plan_of

from scorelane.operators.metrics import (
    adjusted_accuracy,
    compare_runs,
    metric_report,
    metrics,
    metrics_long,
    parse_failures,
)


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, prediction string, label string")


def test_a_run_without_usable_pairs_scores_zero(spark):
    rows = frame(spark, [("a", "sorry", "1,0.65"), ("a", "no, no", "0,0.70")])
    found = metrics(rows, ["run"], mode="pair", metric="binary").first()
    assert (found.binary_accuracy, found.probability_mse, found.num_samples) == (0, None, 2)
    assert found.combined_score is None


def test_no_rows_give_no_metrics(spark):
    rows = frame(spark, [])
    assert metrics(rows, ["run"]).collect() == []
    whole = metrics(rows).first()
    assert (whole.num_samples, whole.accuracy) == (0, None)


def test_tolerance_is_that_of_doubles(spark):
    rows = frame(spark, [("a", "0,0.70", "0,0.80"), ("b", "1,0.65", "1,0.75")])
    found = {row.run: row.probability_accuracy for row in metrics(rows, ["run"], "pair").collect()}
    assert found == {"a": 0.0, "b": 1.0}


def test_a_foreign_label_is_usable_but_never_right(spark):
    rows = frame(spark, [("a", "7,0.50", "0,0.50"), ("a", "0,0.50", "0,0.50")])
    found = metrics(rows, ["run"], "pair", "binary").first()
    assert (found.binary_accuracy, found.probability_accuracy) == (0.5, 1.0)


def test_only_the_chosen_metrics_are_computed(spark):
    rows = frame(spark, [("a", "3.0", "3.0")])
    assert metrics(rows, metric="cl").columns == ["accuracy", "absolute_accuracy", "num_samples"]
    assert metrics(rows, metric="binary").columns == ["binary_accuracy", "num_samples"]
    assert metrics(rows, mode="pair", metric="cl").columns == ["accuracy", "num_samples"]
    with pytest.raises(ValueError):
        metrics(rows, metric="other")


def test_metrics_shuffle_sums_and_not_rows(spark):
    rows = frame(spark, [("a", "3.0", "3.0")] * 10)
    for mode in ("score", "pair"):
        wide = metrics(rows, ["run"], mode=mode)
        assert exchanges(wide) == 1
        assert "partial_count" in plan_of(wide)


def test_adjusted_accuracy_is_strict(spark):
    good = frame(spark, [("a", "3.5", "3.0"), ("a", "3.6", "3.0")])
    found = adjusted_accuracy(good, ["run"]).first()
    assert (found.adjusted_accuracy, found.correct, found.num_samples) == (0.5, 1, 2)
    with pytest.raises(Exception, match="not a score"):
        adjusted_accuracy(frame(spark, [("a", "3.5 of 5", "3.0")])).collect()


def test_failures_are_counted(spark):
    rows = frame(spark, [("a", "x", "3"), ("a", "1,0.5", "3"), ("a", "3.5", "y"), ("a", None, "3")])
    found = parse_failures(rows, ["run"]).first().asDict()
    assert found == {
        "run": "a", "no_score": 3, "no_pair": 2, "no_comma": 3, "no_label_score": 1, "num_samples": 4,
    }


def test_long_form_keeps_numbers_only(spark):
    wide = spark.createDataFrame(
        [("a", 0.03125, None, 4, "note")],
        "run string, accuracy double, combined_score double, num_samples long, remark string",
    )
    found = {row.metric: row.value for row in metrics_long(wide, ["run"]).collect()}
    assert found == {"accuracy": 0.03125, "num_samples": 4.0}
    lines = {row.line for row in metric_report(wide, ["run"]).collect()}
    assert lines == {"ACCURACY: 0.0312", "NUM_SAMPLES: 4.0000"}


def test_runs_are_compared_by_metric(spark):
    before = metrics(frame(spark, [("a", "1.0", "3.0"), ("a", "3.0", "3.0")]), ["run"])
    after = metrics(frame(spark, [("a", "3.0", "3.0"), ("a", "3.0", "3.0")]), ["run"])
    found = {row.metric: (row.before, row.after, row.change) for row in compare_runs(before, after, ["run"]).collect()}
    assert found["accuracy"] == (0.5, 1.0, 0.5)
    assert "num_samples" not in found


def test_failures_come_from_the_metrics_scan(spark, tmp_path):
    """One scan, one shuffle, and as many parsing expressions as the metrics need, for either mode."""
    rows = [("a", t, l) for t in ("3.0", "x", "1,0.65", None, "sorry, no") for l in ("3.0", "0,0.80", "y")]
    frame(spark, rows).write.parquet(str(tmp_path / "r"))
    read = spark.read.parquet(str(tmp_path / "r"))
    for mode, metric in (("score", "both"), ("pair", "both"), ("pair", "binary"), ("score", "cl")):
        both = metrics(read, ["run"], mode, metric, failures=True)
        assert plan_of(both).count("FileScan") == 1 and exchanges(both) == 1
        found, plain, failed = both.first(), metrics(read, ["run"], mode, metric).first(), parse_failures(read, ["run"]).first()
        assert all(found[c] == plain[c] for c in plain.asDict()) and all(found[c] == failed[c] for c in failed.asDict())
