import json

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from scorelane.operators.hints import catalogue_lookup, hint_match_rate, require_match
from scorelane.operators.metrics import metrics
from scorelane.plans.conversion import convert_results
from scorelane.plans.stages import fingerprint, stage
from scorelane.schemas import AUDIO
from scorelane.session import is_complete, path_exists, work_path
from scorelane.sinks.exports import export_manifest
from scorelane.sinks.results import (
    catalogue_entries,
    hint_maps,
    result_documents,
    write_catalogue,
    write_documents,
    write_results,
)
from scorelane.sinks.revisions import restore_revision, restored_rows
from scorelane.sources.hints import audio_column_mismatches, hint_rows, read_catalogue, read_hint_maps
from scorelane.sources.responses import (
    as_of_revision,
    attach_audio_files,
    audio_origin,
    audio_value,
    load_responses,
    optional_question,
    require_columns,
    require_rows,
    union_datasets,
)
from scorelane.sources.results import parallel_array_rows, read_result_documents, result_rows


def foreign(path, content):
    """A document as other programs write it: indented, in one file."""
    path.write_text(json.dumps(content, indent=4, ensure_ascii=False))
    return str(path)


def test_foreign_result_documents(spark, tmp_path):
    pairs = [{"prediction": "3.0", "label": "3.5"}, {"prediction": "sorry – no", "label": "4.0"}]
    foreign(tmp_path / "a.json", {"predictions_and_labels": pairs, "accuracy": 0.5, "num_samples": 2})
    foreign(tmp_path / "b.json", {"samples": pairs[:1]})
    foreign(tmp_path / "c.json", {"all_generated_texts": ["1", "2"], "all_labels": ["1", "3"]})
    docs = read_result_documents(spark, str(tmp_path))
    rows = result_rows(docs, "document").collect()
    found = sorted((r.document[-6:], r.sample_id, r.prediction) for r in rows)
    assert found == [("a.json", 0, "3.0"), ("a.json", 1, "sorry – no"), ("b.json", 0, "3.0")]
    old = parallel_array_rows(docs).collect()
    assert [(r.sample_id, r.prediction, r.label) for r in old] == [(0, "1", "1"), (1, "2", "3")]


def test_foreign_prediction_maps(spark, tmp_path):
    path = foreign(
        tmp_path / "m.json",
        {"binary_predictions": {"0": "1,0.65", "12": "0,0.70", "x": "?"}, "audio_column": "wav_path"},
    )
    maps = read_hint_maps(spark, path)
    assert {r.sample_id: r.hint for r in hint_rows(maps).collect()} == {0: "1,0.65", 12: "0,0.70", None: "?"}
    assert audio_column_mismatches(maps, "wav_file").count() == 1
    assert audio_column_mismatches(maps, "wav_path").count() == 0


def test_missing_prediction_maps(spark, tmp_path):
    path = str(tmp_path / "none")
    assert hint_rows(read_hint_maps(spark, path, "empty")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_hint_maps(spark, path)
    with pytest.raises(ValueError):
        read_hint_maps(spark, path, "ignore")


def test_foreign_catalogue(spark, tmp_path):
    entry = {"binary_preds_path": "p", "form_id": "1764", "audio_column": "w", "accuracy_metrics": {"m": 0.5}}
    path = foreign(tmp_path / "c.json", {"org/a": entry, "org/b": {**entry, "form_id": "1964"}})
    found = {r.dataset: (r.form_id, r.accuracy_metrics) for r in read_catalogue(spark, path).collect()}
    assert found == {"org/a": ("1764", {"m": 0.5}), "org/b": ("1964", {"m": 0.5})}


def run(spark, n=10):
    return spark.range(n).select(
        F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.lit("s").alias("split"),
        F.col("id").alias("sample_id"), F.lit("3.0").alias("prediction"), F.col("id").cast("string").alias("label"),
    )


def test_documents_are_cut_and_whole(spark, tmp_path):
    path = str(tmp_path / "docs")
    write_documents(result_documents(run(spark), 4), path)
    docs = read_result_documents(spark, path, multi_line=False)
    assert sorted((r.first_id, len(r.predictions_and_labels)) for r in docs.collect()) == [(0, 4), (4, 4), (8, 2)]
    assert {(r.sample_id, r.label) for r in result_rows(docs).collect()} == {(i, str(i)) for i in range(10)}


@pytest.mark.parametrize("slice_rows", [1, 2, 3, 4, 10, 100])
def test_documents_refuse_gaps_at_every_size(spark, slice_rows):
    for ids in ([0, 2, 3], [0, 0, 2], [1, 2, 3], [0, 1, 1], [0, 1, 2, 3, 8, 9]):
        rows = run(spark, 1).drop("sample_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "sample_id long"))
        with pytest.raises(Exception, match="gaps"):
            result_documents(rows, slice_rows).collect()
    assert sum(len(r.predictions_and_labels) for r in result_documents(run(spark, 9), slice_rows).collect()) == 9


def test_documents_with_metrics_of_unnamed_runs(spark):
    rows = run(spark).withColumn("split", F.when(F.col("model") == "x", "s"))
    docs = result_documents(rows, 4, metrics=metrics(rows, ["model", "dataset", "split"]))
    assert [r.num_samples for r in docs.collect()] == [10, 10, 10]


def test_sinks_leave_other_runs_alone(spark, tmp_path):
    first, second = run(spark, 4), run(spark, 3).withColumn("model", F.lit("n"))
    for write, path in ((write_results, str(tmp_path / "t")), (write_documents, str(tmp_path / "d"))):
        for rows in (first, second, second):
            write(rows if write is write_results else result_documents(rows, 2), path)
    table = spark.read.schema(first.schema).parquet(str(tmp_path / "t"))
    assert table.groupBy("model").count().orderBy("model").collect() == [("m", 4), ("n", 3)]
    docs = read_result_documents(spark, str(tmp_path / "d"), multi_line=False)
    assert result_rows(docs, "model").groupBy("model").count().orderBy("model").collect() == [("m", 4), ("n", 3)]
    for model in ("org/a:b c", "other/a:b c", "org/a:b c"):
        wide = metrics(first.withColumn("dataset", F.lit(model)), ["dataset"])
        entries = catalogue_entries(wide, F.lit("p"), F.lit("1764"), F.lit("w"))
        write_catalogue(entries, str(tmp_path / "c"))
    found = read_catalogue(spark, str(tmp_path / "c"), multi_line=False).collect()
    assert sorted(r.dataset for r in found) == ["org/a:b c", "other/a:b c"]


def test_small_aggregates_do_not_move_the_rows(spark, tmp_path):
    """Old rows are not shuffled by dataset, however low Spark's own threshold is."""
    rows = table(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        for found in (as_of_revision(rows, 1), restored_rows(rows, 1)):
            assert "Exchange hashpartitioning" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)
        docs = result_documents(run(spark), 4, metrics=metrics(run(spark), ["model", "dataset", "split"]))
        assert "SortMergeJoin" not in plan_of(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_foreign_maps_are_named(spark, tmp_path):
    content = {"binary_predictions": {"0": "1,0.65"}, "form_id": "1764", "audio_column": "w"}
    path = foreign(tmp_path / "near_model_Set_A_test.json", content)
    one = read_hint_maps(spark, path, dataset="d", split="s").first()
    assert (one.dataset, one.split) == ("d", "s")
    one = read_hint_maps(spark, path, datasets=["Set", "Set_A"], splits=["test"]).first()
    assert (one.dataset, one.split) == ("Set_A", "test")
    hints = hint_rows(read_hint_maps(spark, path, dataset="d", split="s"), "dataset", "split")
    rows = run(spark, 4)
    rate = hint_match_rate(rows, hints).first()
    assert (rate.responses, rate.hinted, rate.rate) == (4, 1, 0.25)
    assert require_match(rows, hints) is rows
    with pytest.raises(ValueError, match="no hint fits"):
        require_match(rows, hint_rows(read_hint_maps(spark, path), "dataset", "split"))


def test_lookups_fail_on_unlisted_datasets(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "dataset string, n int")
    entry = spark.createDataFrame(
        [("a", "p", "1764", "w")], "dataset string, binary_preds_path string, form_id string, audio_column string"
    )
    assert catalogue_lookup(rows.where("n = 1"), entry).first().binary_preds_path == "p"
    for n in (2, 3):
        with pytest.raises(Exception, match="no catalogue entry"):
            catalogue_lookup(rows.where(f"n = {n}"), entry).collect()


def test_one_map_per_slice(spark):
    hints = run(spark).withColumnRenamed("prediction", "hint").where("sample_id <> 3")
    found = hint_maps(hints, "wav_path", 5).collect()
    assert sorted(len(r.binary_predictions) for r in found) == [4, 5]
    first = next(r for r in found if "0" in r.binary_predictions)
    assert list(first.binary_predictions) == ["0", "1", "2", "4"]


def test_catalogue_keeps_computed_metrics(spark, tmp_path):
    wide = metrics(run(spark), ["dataset"]).withColumn("combined_score", F.lit(None).cast("double"))
    entries = catalogue_entries(wide, F.lit("p"), F.lit("1764"), F.lit("w"))
    write_catalogue(entries, str(tmp_path / "c"))
    found = read_catalogue(spark, str(tmp_path / "c"), multi_line=False).first()
    assert set(found.accuracy_metrics) == {"accuracy", "absolute_accuracy", "binary_accuracy", "num_samples"}


def table(spark, path):
    rows = spark.createDataFrame(
        [(i, d, "dev" if i % 2 else "test", r) for i in range(8) for d in ("a", "b") for r in (1, 2)],
        "sample_id long, dataset string, split string, revision long",
    )
    write_results(rows, path, ["dataset", "split", "revision"])
    return spark.read.schema(rows.schema).parquet(path)


def test_only_the_chosen_folders_are_read(spark, tmp_path):
    rows = table(spark, str(tmp_path / "t"))
    chosen = load_responses(spark, str(tmp_path / "t"), "a", "dev", revision=2, schema=rows.schema)
    assert chosen.count() == 4
    plan = plan_of(chosen)
    assert "PartitionFilters: [isnotnull(dataset" in plan and "DataFilters: []" in plan
    read = {r.file_path for r in chosen.select("_metadata.file_path").collect()}
    assert all("dataset=a/split=dev/revision=2" in path for path in read)


def test_subsets_are_chosen_too(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "a", "dev", 1, "x" if i % 2 else "y") for i in range(6)],
        "sample_id long, dataset string, split string, revision long, subset string",
    )
    path = str(tmp_path / "t")
    write_results(rows, path, ["dataset", "split", "revision"])
    chosen = load_responses(spark, path, "a", "dev", subset="x", schema=rows.schema)
    assert [r.sample_id for r in chosen.collect()] == [1, 3, 5]
    assert load_responses(spark, path, "a", "test", schema=rows.schema).count() == 0


def test_revisions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = table(spark, path)
    assert {r.revision for r in as_of_revision(rows, 1).collect()} == {1}
    assert {r.revision for r in as_of_revision(rows, 9).collect()} == {2}
    for _ in range(2):  # a repeated restore adds another newest revision each time
        restore_revision(spark.read.schema(rows.schema).parquet(path), path, 1, ["dataset", "split", "revision"])
    counts = spark.read.schema(rows.schema).parquet(path).groupBy("revision").count().collect()
    assert {r.revision: r["count"] for r in counts} == {1: 16, 2: 16, 3: 16, 4: 16}
    with pytest.raises(ValueError):
        restore_revision(rows, str(tmp_path / "none"), 1, ["revision"])


def test_checks_before_a_job(spark):
    rows = spark.createDataFrame([(1, None)], "sample_id long, prompt string")
    with pytest.raises(ValueError, match="grade"):
        require_columns(rows, ["sample_id", "grade"])
    with pytest.raises(ValueError, match="no rows"):
        require_rows(rows.where("false"))
    assert require_rows(rows) is rows
    assert optional_question(rows).first().prompt == ""
    assert optional_question(rows.drop("prompt")).first().prompt == ""
    both = union_datasets([rows, rows.drop("prompt").withColumn("grade", F.lit(3.0))])
    assert both.columns == ["sample_id", "prompt", "grade"] and both.count() == 2


def test_audio_from_struct_path_or_fallback(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.wav").write_bytes(b"abc")
    (tmp_path / "a.wav").write_bytes(b"other")
    paths = spark.createDataFrame([(1, "x/a.wav"), (2, "x/none.wav"), (3, None)], "sample_id long, clip string")
    found = paths.select("sample_id", audio_value(paths, "clip").alias("audio"))
    origins = found.select("sample_id", audio_origin(F.col("audio")).alias("o")).orderBy("sample_id").collect()
    assert [r.o for r in origins] == ["path", "path", "none"]
    files = attach_audio_files(found, "audio", str(tmp_path)).orderBy("sample_id").collect()
    assert [None if r.content is None else bytes(r.content) for r in files] == [b"abc", None, None]
    none = paths.select(audio_value(paths.select("sample_id"), "clip").alias("audio")).first()
    assert none.audio is None


def test_audio_with_samples_comes_before_a_path(spark):
    audio = "struct<array:array<float>,sampling_rate:int,path:string>"
    own, path, none = ([0.5], 16000, "f.wav"), (None, None, "p.wav"), (None, None, None)
    rows = spark.createDataFrame(
        [(1, own, path, "c.wav"), (2, path, own, "c.wav"), (3, path, None, None), (4, none, path, None), (5, None, None, "c.wav")],
        f"sample_id long, wav_path {audio}, audio {audio}, clip string",
    )

    def origins(column):
        value = audio_value(rows, column)
        found = rows.select("sample_id", audio_origin(value).alias("o"), value["path"].alias("p"))
        return [(r.o, r.p) for r in found.orderBy("sample_id").collect()]

    assert origins("wav_path") == [("array", "f.wav"), ("array", "f.wav"), ("path", "p.wav"), ("path", "p.wav"), ("none", None)]
    assert origins("clip") == [("path", "c.wav"), ("array", "f.wav"), ("none", None), ("path", "p.wav"), ("path", "c.wav")]


def test_export_names_leave_out_what_is_null(spark):
    rows = spark.createDataFrame(
        [(1, None, None, ([0.1], 16000, "a.wav")), (2, 7, 3.0, ([0.1], 16000, "b.wav"))],
        "sample_id long, speaker_id long, grade double, audio struct<array:array<float>,sampling_rate:int,path:string>",
    )
    found = export_manifest(rows)[0].orderBy("sample_id").collect()
    assert [r.file_name for r in found] == ["1_a.wav", "2_speaker_7_b_score_3.0.wav"]
    assert found[0].metadata == "Sample index: 1\nOriginal filename: a.wav\nSampling rate: 16000 Hz\n"


def test_export_without_optional_columns(spark):
    rows = spark.createDataFrame(
        [(42, 3.5, ([0.1], 16000, "d/a.wav.wav")), (43, 4.0, ([0.1], 8000, None)), (44, 4.0, None)],
        "sample_id long, grade double, wav_path struct<array:array<float>,sampling_rate:int,path:string>",
    )
    manifest, skipped = export_manifest(rows, "wav_path")
    found = manifest.orderBy("sample_id").collect()
    assert [r.file_name for r in found] == ["42_a_score_3.5.wav", "43_sample_43_score_4.0.wav"]
    assert found[0].metadata == (
        "Sample index: 42\nOriginal filename: d/a.wav.wav\nTruth score: 3.5\nSampling rate: 16000 Hz\n"
    )
    assert [r.sample_id for r in skipped.collect()] == [44]
    with pytest.raises(ValueError):
        export_manifest(rows, "clip")
    assert rows.schema["wav_path"].dataType.names == AUDIO.names


def test_a_half_written_stage_is_built_again(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = spark.createDataFrame([("1764", 1)], "form string, n int")
    stage(spark, path, lambda: frame, ["form"])
    assert is_complete(spark, path)
    other = frame.withColumn("n", F.lit(2))
    kept = stage(spark, path, lambda: other, ["form"]).first()
    assert (kept.form, kept.n) == ("1764", 1)  # names that look like numbers stay text
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert stage(spark, path, lambda: other, ["form"]).first().n == 2
    assert stage(spark, path, lambda: frame, ["form"], reuse=False).first().n == 1


def test_a_stage_of_another_build_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "form string, n int")
    own = {"model": "m", "rows": fingerprint(frame, ["n"])}
    stage(spark, path, lambda: frame, ["form"], identity=own)
    assert stage(spark, path, lambda: frame.limit(0), ["form"], identity=own).count() == 2
    assert own["rows"] == fingerprint(frame.repartition(3), ["n"]) != fingerprint(frame.limit(1), ["n"])
    for other in ({**own, "model": "x"}, {**own, "rows": "3:1"}, {}):
        with pytest.raises(ValueError, match="another build"):
            stage(spark, path, lambda: frame, ["form"], identity=other)
    assert stage(spark, path, lambda: frame.limit(1), ["form"], reuse=False, identity=own).count() == 1


class Session:
    """As much of a session as ``work_path`` looks at."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master
        self.own = None

    def setCheckpointDir(self, path):
        self.own = path

    def getCheckpointDir(self):
        return self.own


def test_the_working_folder_is_the_shared_one(spark):
    cluster = Session("yarn", "hdfs://shared/checkpoints/")
    first, second = work_path(cluster, "x"), work_path(cluster, "x")
    assert first.startswith("hdfs://shared/checkpoints/scorelane/x-") and first != second
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_path(Session("yarn"), "x")
    local = Session("local[2]")
    assert work_path(local, "x").startswith(local.own)
    assert not path_exists(spark, work_path(spark, "x"))


def test_foreign_results_are_converted_file_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pairs = [{"prediction": p, "label": "x"} for p in (" 1,0.65\n", "4.5", "0,0.70")]
    foreign(tmp_path / "in" / "results_SetA_1964.json", {"predictions_and_labels": pairs})
    foreign(tmp_path / "in" / "results_SetB.json", {"samples": pairs[:1]})
    out = str(tmp_path / "results_out")
    names = {"SetA": "org/SetA", "SetB": "org/SetB"}
    hints = convert_results(spark, str(tmp_path / "in"), out, "wav_path", 100, names=names, split="test")
    assert {r.split for r in hints.collect()} == {"test"}
    assert {(r.dataset, r.sample_id, r.hint) for r in hints.collect()} == {
        ("org/SetA", 0, "1,0.65"), ("org/SetA", 2, "0,0.70"), ("org/SetB", 0, "1,0.65"),
    }
    first = read_hint_maps(spark, f"{out}/file=preds_SetA_1964.json", multi_line=False).first()
    assert (first.form_id, first.audio_column, first.dataset) == ("1964", "wav_path", "org/SetA")
    assert first.binary_predictions == {"0": "1,0.65", "2": "0,0.70"}
    other = read_hint_maps(spark, f"{out}/file=preds_SetB.json", multi_line=False).first()
    assert (other.form_id, other.binary_predictions) == ("1764", {"0": "1,0.65"})
    (tmp_path / "more").mkdir()
    foreign(tmp_path / "more" / "results_SetC.json", {"samples": pairs[:1]})
    convert_results(spark, str(tmp_path / "more"), out, "wav_path", 100, names={"SetC": "org/SetC"}, split="dev")
    maps = read_hint_maps(spark, out, multi_line=False).collect()
    assert sorted((m.dataset, m.split) for m in maps) == [("org/SetA", "test"), ("org/SetB", "test"), ("org/SetC", "dev")]


def test_damaged_documents_are_not_taken_for_empty_ones(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"binary_predictions": {"0": "1,0.65"')
    with pytest.raises(Exception, match="FAILFAST"):
        read_result_documents(spark, str(path)).collect()
    with pytest.raises(Exception, match="FAILFAST"):
        read_hint_maps(spark, str(path)).collect()
    with pytest.raises(Exception, match="FAILFAST"):
        read_catalogue(spark, str(path)).collect()
    assert hint_rows(read_hint_maps(spark, str(path), "empty")).count() == 0
