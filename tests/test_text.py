from helpers import column
from pyspark.sql import functions as F

from scorelane.functions.text import (
    add_suffix,
    dataset_of,
    form_of,
    model_id,
    predictions_path,
    read_result_name,
    remove_markers,
    remove_suffix,
    result_name,
)


def test_suffixes_come_off_the_end_only(spark):
    texts = ["3.5<|end|><|endoftext|>", "<|end|><|endoftext|>3.5", "3.5", ""]
    assert column(spark, texts, remove_suffix) == [t.removesuffix("<|end|><|endoftext|>") for t in texts]
    assert column(spark, [3.5, 4.0], add_suffix, "double") == [
        "3.5<|end|><|endoftext|>", "4.0<|end|><|endoftext|>",
    ]


def test_markers_go_wherever_they_stand(spark):
    texts = ["<|end|> 3.5\n<|endoftext|>", "a<|end|>b", " plain "]
    assert column(spark, texts, remove_markers) == ["3.5", "ab", "plain"]


def test_forms_and_datasets_from_paths(spark):
    paths = ["a/results_1964.json", "a/1572.json", "b/Train-1764.json"]
    assert column(spark, paths, form_of) == ["1964", "1764", "1764"]
    names = {"1964": "org/second", "results": "org/never", "1764": "org/first"}
    found = column(spark, paths, lambda p: dataset_of(p, names, "org/other"))
    assert found == ["org/second", "org/other", "org/first"]


def test_only_the_base_name_of_a_result_path_changes(spark):
    cases = {
        "eval_results/binary_results_x.json": "eval_results/binary_preds_x.json",
        "results_results.json": "preds_results.json",
        "eval_results/other.json": "eval_results/other.json",
    }
    assert column(spark, list(cases), predictions_path) == list(cases.values())


def test_result_names_and_back(spark):
    rows = spark.createDataFrame(
        [("org/m_1", "org/Set_A", "full_test"), ("m", "Set", "test")], "m string, d string, s string"
    )
    named = rows.select(result_name(F.col("m"), F.col("d"), F.col("s"), "_guided").alias("n"))
    assert [r.n for r in named.collect()] == ["m_1_Set_A_full_test_guided.json", "m_Set_test_guided.json"]
    back = named.select(
        read_result_name(F.col("n"), ["Set", "Set_A"], ["test", "full_test"], ["_guided"]).alias("r")
    )
    assert [tuple(r.r) for r in back.collect()] == [("m_1", "Set_A", "full_test"), ("m", "Set", "test")]
    foreign = column(spark, ["x.json"], lambda n: read_result_name(n, ["Set"], ["test"])["model"])
    assert foreign == [None]


def test_default_model_ids_get_their_form(spark):
    found = column(spark, ["org/base", "org/own"], lambda m: model_id(m, "org/base", F.lit("1964")))
    assert found == ["org/base_1964", "org/own"]
