import json

import pytest

from scorelane.operators.hints import settled_hints
from scorelane.sources.hints import hint_rows, read_hint_maps
from scorelane.sources.indented import indented_hint_rows, indented_result_rows
from scorelane.sources.results import read_result_documents, result_rows

TEXTS = ["1,0.65", 'a "quoted" {text} [x], with: all', "back\\slash", "line\nbreak", "é漢 ", "", "{", "}]"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines each, so that entries, objects and sections cross them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def documents(key):
    pairs = [{"prediction": TEXTS[i % 8] + str(i), "label": None if i % 5 == 0 else TEXTS[i % 7]} for i in range(60)]
    other = {"samples" if key != "samples" else "notes": [{"prediction": "no", "label": "no"}]}
    return {"accuracy": 0.5, **other, key: pairs, "num_samples": 60, "more": {"a": [1, {"prediction": "x"}]}}


@pytest.mark.parametrize("indent", [1, 4, "\t"])
def test_documents_by_line(spark, tmp_path, small_splits, indent):
    for name, key in (("one", "predictions_and_labels"), ("two", "samples")):
        (tmp_path / f"{name}.json").write_text(json.dumps(documents(key), indent=indent, ensure_ascii=False))
    (tmp_path / "none.json").write_text(json.dumps({"accuracy": 1.0}, indent=indent))
    (tmp_path / "empty.json").write_text(json.dumps({"predictions_and_labels": []}, indent=indent))
    path = str(tmp_path)
    found = indented_result_rows(spark, path)
    expected = result_rows(read_result_documents(spark, path), "document")
    rows = sorted(map(str, (tuple(r) for r in found.collect())))
    assert rows == sorted(map(str, (tuple(r) for r in expected.collect()))) and len(rows) == 120
    assert spark.read.text(path).rdd.getNumPartitions() > 40


def test_maps_by_line(spark, tmp_path, small_splits):
    hints = {str(i): TEXTS[i % 8] for i in range(80)}
    named = {"form_id": "1964", "binary_predictions": hints, "audio_column": "wav_path"}
    (tmp_path / "results_a_b_dev.json").write_text(json.dumps(named, indent=2))
    (tmp_path / "results_c_dev.json").write_text(json.dumps({"binary_predictions": {}, "dataset": "d"}, indent=2))
    how = {"datasets": ["a_b", "c"], "splits": ["dev"]}
    keep = ["dataset", "split", "form_id", "audio_column"]
    found = indented_hint_rows(spark, str(tmp_path), **how).drop("place")
    expected = hint_rows(read_hint_maps(spark, str(tmp_path), **how), *keep)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == 80
    assert {r.dataset for r in indented_hint_rows(spark, str(tmp_path), dataset="x", split="y").collect()} == {"x"}


def test_the_last_of_a_repeated_id_is_told(spark, tmp_path, small_splits):
    entries = ",\n".join(f'    "{i % 30}": "text {i}"' for i in range(90))
    (tmp_path / "map.json").write_text('{\n  "binary_predictions": {\n' + entries + "\n  }\n}\n")
    rows = indented_hint_rows(spark, str(tmp_path), dataset="a", split="b")
    last = {r.sample_id: r.hint for r in settled_hints(rows, order=["place"]).collect()}
    assert rows.count() == 90 and last == {i: f"text {i + 60}" for i in range(30)}


def test_damaged_documents_fail(spark, tmp_path):
    whole = json.dumps({"binary_predictions": {"1": "a", "2": "b"}}, indent=2)
    for number, (text, match) in enumerate([
        (whole[:-2], "do not close"), (whole.replace('"1": "a"', '"1" "a"'), "no entry"),
        ('{\n"binary_predictions": {"1": "a"}\n}', "share a line"),
    ]):
        path = tmp_path / str(number)
        path.mkdir()
        (path / "map.json").write_text(text)
        with pytest.raises(Exception, match=match):
            indented_hint_rows(spark, str(path), dataset="a", split="b").collect()
