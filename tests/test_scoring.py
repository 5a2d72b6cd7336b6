import sys

import pandas as pd
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from helpers import plan_of
from scorelane.operators.hints import HINT_KEYS
from scorelane.operators.prompts import hint_examples, supervised_examples
from scorelane.operators.scoring import batch_ends, score_batches
from scorelane.plans.evaluation import Model, cascade, evaluate, ready, score, score_answers
from scorelane.sinks.results import write_bucketed

# workers cannot import test modules
register_pickle_by_value(sys.modules[__name__])


def sizes():
    """A scorer that answers with the size of its batch."""
    return lambda batch: [str(len(batch))] * len(batch)


def loads():
    """A scorer that tells which process loaded it, and when."""
    import os
    import uuid

    made = f"{os.getpid()}:{uuid.uuid4().hex}"
    return lambda batch: [made] * len(batch)


def others():
    return lambda batch: ["other"] * len(batch)


def arrays(table):
    """A scorer of Arrow tables: the number of values of each nested array."""
    return [str(len(frames)) for frames in table.column("frames").to_pylist()]


def short():
    return lambda batch: ["x"]


def test_batches_have_the_asked_size(spark):
    rows = spark.range(10, numPartitions=1)
    found = score_batches(rows, "t/sizes", sizes, ["id"], ["id"], batch_size=4)
    assert {r.id: r.prediction for r in found.collect()} == {i: "4" if i < 8 else "2" for i in range(10)}


def test_only_named_columns_are_sent(spark):
    rows = spark.range(3).withColumn("wide", F.lit("payload"))
    found = score_batches(rows, "t/sizes", sizes, ["id"], ["id"])
    assert "payload" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["id", "prediction"]


def test_a_model_is_loaded_once_per_worker(spark):
    """Every process has loaded one model, however many partitions it has worked through."""
    rows = spark.range(320, numPartitions=64)
    found = score_batches(rows, "t/loads", loads, ["id"], ["id"]).collect()
    made = {r.prediction for r in found}
    assert len(found) == 320 and len(made) == len({m.split(":")[0] for m in made})


def test_models_are_told_apart_by_their_factory(spark):
    """Another factory under the same name is another model."""
    rows = spark.range(8, numPartitions=1)
    assert {r.prediction for r in score_batches(rows, "t/same", sizes, ["id"], ["id"]).collect()} == {"4"}
    assert {r.prediction for r in score_batches(rows, "t/same", others, ["id"], ["id"]).collect()} == {"other"}


def test_nested_inputs_go_as_arrow_tables(spark):
    rows = spark.range(10, numPartitions=1).withColumn("frames", F.array_repeat(F.array(F.lit(1.0)), F.col("id").cast("int")))
    found = score_batches(rows, "t/arrays", lambda: arrays, ["frames"], ["id"], arrow=True)
    assert {r.id: r.prediction for r in found.collect()} == {i: str(i) for i in range(10)}
    assert "ArrowPython" in found._jdf.queryExecution().toString() or "MapInArrow" in found._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="1 answers for 4 rows"):
        score_batches(rows, "t/short", short, ["frames"], ["id"], arrow=True).collect()


def test_a_scorer_must_answer_every_row(spark):
    with pytest.raises(Exception, match="1 answers for 4 rows"):
        score_batches(spark.range(8, numPartitions=1), "t/short", short, ["id"], ["id"]).collect()
    with pytest.raises(ValueError):
        score_batches(spark.range(1), "t/short", short, ["id"], ["id"], batch_size=0)


def counting(path, answers):
    """A scorer that leaves a mark for each batch it is asked for."""

    def factory():
        import uuid
        from pathlib import Path

        def answer(batch: pd.DataFrame):
            (Path(path) / uuid.uuid4().hex).touch()
            return [answers] * len(batch)

        return answer

    return factory


def responses(spark):
    return spark.range(20).select(
        F.when(F.col("id") < 14, "a").otherwise("b").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("id").alias("sample_id"),
        F.lit("Why?").alias("prompt"),
        F.lit(3.0).alias("grade"),
    )


def test_evaluation_scores_once_and_resumes(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    model = Model("t/counting", counting(str(marks), "3.5"), ("prompt_text",), 100)
    path = str(tmp_path / "out")
    rows, wide = evaluate(spark, responses(spark), model, path)
    rows.count()
    found = {r.dataset: (r.accuracy, r.num_samples) for r in wide.collect()}
    assert found == {"a": (1.0, 14), "b": (1.0, 6)}
    asked = len(list(marks.iterdir()))
    _, again = evaluate(spark, responses(spark), model, path)
    again.collect()
    assert len(list(marks.iterdir())) == asked


def test_a_changed_run_is_refused(spark, tmp_path):
    """Another scorer, other responses, or another target at a place that is complete."""
    path = str(tmp_path / "out")
    model = Model("t/others", others, ("prompt_text",))
    evaluate(spark, responses(spark), model, path)
    assert evaluate(spark, responses(spark), model, path)[0].count() == 20
    more = responses(spark).unionByName(responses(spark).withColumn("sample_id", F.col("sample_id") + 100))
    for rows, used, target in (
        (more, model, "score"), (responses(spark), Model("t/others", sizes, ("prompt_text",)), "score"),
        (responses(spark), model, "pair"),
    ):
        with pytest.raises(ValueError, match="another build"):
            evaluate(spark, rows, used, path, target=target)
    rows, _ = evaluate(spark, responses(spark), Model("t/sizes", sizes, ("prompt_text",)), path)
    assert {r.prediction for r in rows.collect()} <= {"1", "2", "3", "4"}


def test_limits_and_empty_sets(spark, tmp_path):
    model = Model("t/others", others, ("prompt_text",))
    _, wide = evaluate(spark, responses(spark), model, str(tmp_path), limit=5)
    assert {r.dataset: r.num_samples for r in wide.collect()} == {"a": 5, "b": 5}
    with pytest.raises(ValueError, match="no rows"):
        evaluate(spark, responses(spark).limit(0), model, str(tmp_path / "e"))


def test_hints_that_fit_nothing_fail_the_cascade(spark, tmp_path):
    first = Model("t/none", others, ("prompt_text",))
    with pytest.raises(ValueError, match="no hint fits"):
        cascade(spark, responses(spark), first, Model("t/echo", echo, ("prompt_text",)), str(tmp_path), strict=True)


def test_bucketed_responses_stay_where_they_are(spark, tmp_path):
    """Neither stage of a cascade shuffles the audio of a bucketed table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = responses(spark).withColumn("audio", F.array(F.lit(0.5)))
        write_bucketed(wide, "cascade_responses", str(tmp_path / "t"), 4, list(HINT_KEYS))
        rows = spark.table("cascade_responses")
        hints = responses(spark).select(*HINT_KEYS, F.lit("1,0.65").alias("hint"))
        hints.write.parquet(str(tmp_path / "h"))
        examples = hint_examples(rows, spark.read.parquet(str(tmp_path / "h")))
        plan = plan_of(score(examples, Model("t/echo", echo, ("prompt_text", "audio"))))
        above = [line for line in plan.split("\n") if "Exchange" in line]
        assert len(above) == 1 and "SortMergeJoin" in plan
        assert "audio" in plan and "audio" not in plan[plan.index("Exchange") :]
    finally:
        spark.sql("DROP TABLE IF EXISTS cascade_responses")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_single_answers_are_cleaned(spark):
    def factory():
        return lambda batch: [" 3.0 <|end|>" for _ in batch["prompt_text"]]

    rows = supervised_examples(ready(responses(spark), 3), variant="single")
    model = Model("t/cleaned", factory, ("prompt_text",), 1)
    for target, answer in (("score", "3.0"), ("pair", "0,0.25")):
        found = score_answers(rows, model, target).collect()
        assert len(found) == 6 and {(r.prediction, r.answer) for r in found} == {(" 3.0 <|end|>", answer)}


def test_results_lie_in_few_files(spark, tmp_path):
    """However many tasks scored, a folder has one file of so few rows."""
    model = Model("t/others", others, ("prompt_text",))
    rows, _ = evaluate(spark, responses(spark).repartition(16), model, str(tmp_path))
    files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
    assert len(files) == 2 and rows.count() == 20


def echo():
    """Answers 4.5 where the prompt hints at a pass, else 2.0."""
    return lambda batch: ["4.5" if "First model: 1," in text else "2.0" for text in batch["prompt_text"]]


def by_id():
    return lambda batch: ["1,0.65" if i % 2 else "0,0.70" for i in batch["sample_id"]]


def test_cascade_hands_hints_on(spark, tmp_path):
    first = Model("t/by-id", by_id, ("prompt_text", "sample_id"))
    second = Model("t/echo", echo, ("prompt_text",))
    rows, wide = cascade(spark, responses(spark), first, second, str(tmp_path))
    found = {r.sample_id: r.prediction for r in rows.collect()}
    assert found == {i: "4.5" if i % 2 else "2.0" for i in range(20)}
    assert sum(r.num_samples for r in wide.collect()) == 20


def told():
    """A scorer that tells the rows and the bytes of its batch."""
    return lambda batch: [f"{len(batch)}:{sum(map(len, batch['text']))}"] * len(batch)


def told_of_tables():
    return lambda table: [f"{table.num_rows}:{sum(map(len, table.column('text').to_pylist()))}"] * table.num_rows


@pytest.mark.parametrize("arrow", [False, True])
def test_batches_are_closed_by_bytes_too(spark, arrow):
    """One row is a hundred times the others: it goes alone, order is kept, and no batch is larger."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(60, numPartitions=1).withColumn(
            "text", F.repeat(F.lit("x"), F.when(F.col("id") == 20, 10_000).otherwise(100).cast("int"))
        )
        maker = told_of_tables if arrow else told
        found = score_batches(rows, f"t/told-{arrow}", maker, ["text"], ["id"], 4, arrow=arrow, max_bytes=1000).collect()
        assert [r.id for r in found] == list(range(60))
        sizes = {r.id: r.prediction for r in found}
        assert sizes[20] == "1:10000" and sizes[0] == sizes[19] == "4:400" and sizes[21] == "4:400"
        few = score_batches(rows, f"t/told-{arrow}", maker, ["text"], ["id"], 50, arrow=arrow, max_bytes=1000).collect()
        assert max(int(r.prediction.split(":")[1]) for r in few if r.id != 20) <= 1000
        assert {r.prediction.split(":")[0] for r in few if r.id < 10} <= {"9", "8", "10", "1"}
        # without a bound batches are full across Arrow batches
        whole = score_batches(rows, f"t/told-{arrow}", maker, ["text"], ["id"], 16, arrow=arrow).collect()
        assert [r.prediction.split(":")[0] for r in whole] == ["16"] * 48 + ["12"] * 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batch_ends():
    assert batch_ends([1, 1, 1, 1, 1], 2, None, True) == [2, 4, 5]
    assert batch_ends([1, 1, 1, 1, 1], 2, None, False) == [2, 4]
    assert batch_ends([5, 90, 5, 5, 200, 5], 4, 100, True) == [3, 4, 5, 6]
    assert batch_ends([], 4, 10, True) == []


def places():
    """A scorer that keeps its batches and tells where in memory the whole frame of each begins."""
    held = []

    def answer(batch):
        held.append(batch)
        number = batch["number"].to_numpy()
        return [str(number.__array_interface__["data"][0] - 8 * int(number[0]))]

    return answer


def test_batches_of_one_row_do_not_copy_the_frame(spark):
    """Batches are views of the rows that Arrow brought: a copy of all for each row takes as many squared."""
    rows = spark.range(50, numPartitions=1).select("id", F.col("id").alias("number"))
    found = score_batches(rows, "t/places", places, ["number"], ["id"], 1).collect()
    assert len(found) == 50 and len({r.prediction for r in found}) == 1
