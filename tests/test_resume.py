import importlib
import sys

import pandas as pd
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from scorelane.operators.identity import code_digest
from scorelane.plans.evaluation import Model, evaluate
from scorelane.plans.resume import input_digest, read_note

# workers cannot import test modules
register_pickle_by_value(sys.modules[__name__])

COLUMNS = "dataset string, split string, sample_id long, prompt string, grade double"


def noting(path, fail_at=None):
    """A scorer that leaves the prompt of each row it is asked for, and may fail at one of them."""

    def factory():
        import uuid
        from pathlib import Path

        def answer(batch: pd.DataFrame):
            if fail_at is not None and fail_at in list(batch["sample_id"]):
                raise RuntimeError("lost")
            for number in batch["sample_id"]:
                (Path(path) / f"{number}-{uuid.uuid4().hex}").touch()
            return [f"{n % 5}.0" for n in batch["sample_id"]]

        return answer

    return factory


class Asked:
    """What a scorer was asked for since the last look."""

    def __init__(self, folder):
        self.folder, self.known = folder, set()
        folder.mkdir()

    def model(self, **how):
        return Model("t/noting", noting(str(self.folder), **how), ("prompt_text", "sample_id"), 100, version="1")

    def since(self):
        now = {p.name for p in self.folder.iterdir()}
        new, self.known = now - self.known, now
        return sorted(int(name.rpartition("-")[0]) for name in new)


@pytest.fixture
def asked(tmp_path):
    return Asked(tmp_path / "asked")


def responses(spark, ids, prompt="Why?", dataset="a"):
    return spark.createDataFrame([(dataset, "dev", i, prompt, 3.0) for i in ids], COLUMNS).repartition(3)


def numbers(rows):
    return sorted(r.sample_id for r in rows.collect())


def test_only_new_and_changed_rows_are_scored(spark, tmp_path, asked):
    path = str(tmp_path / "out")
    rows, _ = evaluate(spark, responses(spark, range(10)), asked.model(), path)
    assert numbers(rows) == asked.since() == list(range(10))
    grown = responses(spark, range(2, 10)).unionByName(responses(spark, range(10, 14)))
    with pytest.raises(ValueError, match="another build.*examples"):
        evaluate(spark, grown, asked.model(), path)
    rows, wide = evaluate(spark, grown, asked.model(), path, grow=True)
    assert numbers(rows) == list(range(2, 14)) and asked.since() == [10, 11, 12, 13]
    assert wide.first().num_samples == 12
    # one that was gone comes back and is found; one that is asked otherwise is scored
    back = responses(spark, range(8)).unionByName(responses(spark, [8], prompt="How?"))
    rows, _ = evaluate(spark, back, asked.model(), path, grow=True)
    assert numbers(rows) == list(range(9)) and asked.since() == [8]
    rows, _ = evaluate(spark, back, asked.model(), path, grow=True)
    assert numbers(rows) == list(range(9)) and asked.since() == []


def test_a_lost_run_keeps_its_finished_parts(spark, tmp_path, asked):
    path = str(tmp_path / "out")
    model = asked.model(fail_at=17)
    with pytest.raises(Exception, match="lost"):
        evaluate(spark, responses(spark, range(40)), model, path, parts=8)
    note = read_note(spark, f"{path}/{model.folder}")
    assert not note["complete"] and len(note["parts"]) < 8
    kept = [n for part in note["parts"] for n in numbers(spark.read.parquet(f"{path}/{model.folder}/{part}"))]
    asked.since()
    rows, _ = evaluate(spark, responses(spark, range(40)), asked.model(), path, parts=4)
    assert numbers(rows) == list(range(40))
    assert asked.since() == sorted(set(range(40)) - set(kept))


def test_an_unfinished_part_is_not_read(spark, tmp_path, asked):
    path = str(tmp_path / "out")
    model = asked.model()
    rows, _ = evaluate(spark, responses(spark, range(5)), model, path)
    rows.write.parquet(f"{path}/{model.folder}/part=lost")
    rows, _ = evaluate(spark, responses(spark, range(5)), model, path)
    assert numbers(rows) == list(range(5))


def test_written_anew(spark, tmp_path, asked):
    path = str(tmp_path / "out")
    evaluate(spark, responses(spark, range(5)), asked.model(), path)
    asked.since()
    rows, _ = evaluate(spark, responses(spark, range(3)), asked.model(), path, reuse=False)
    assert numbers(rows) == asked.since() == [0, 1, 2]
    with pytest.raises(ValueError, match="parts"):
        evaluate(spark, responses(spark, range(3)), asked.model(), path, parts=0, reuse=False)


def test_names_that_are_null_or_empty_stay_apart(spark, tmp_path, asked):
    parts = [responses(spark, [n], dataset=name) for n, name in enumerate([None, "", "a"])]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for _ in range(2):
        rows, wide = evaluate(spark, every, asked.model(), str(tmp_path / "out"))
        assert {r.sample_id: r.dataset for r in rows.collect()} == {0: None, 1: "", 2: "a"}
        assert {r.dataset for r in wide.collect()} == {None, "", "a"}
    assert asked.since() == [0, 1, 2]


def test_repeated_responses_stay_repeated(spark, tmp_path, asked):
    twice = responses(spark, [1, 1, 2])
    for _ in range(2):
        rows, _ = evaluate(spark, twice, asked.model(), str(tmp_path / "out"))
        assert numbers(rows) == [1, 1, 2]


def test_a_first_run_reads_its_examples_once(spark, tmp_path):
    """The digest is made in the scoring job: no other job of the run reads the responses' prompts."""
    source = str(tmp_path / "source")
    responses(spark, range(50)).write.parquet(source)
    read = spark.read.parquet(source)
    seen = []

    def build(part):
        seen.append(part)
        return part.select("dataset", "split", "sample_id", "input_digest", F.lit("1.0").alias("prediction"))

    from scorelane.plans.resume import scored_parts

    found = scored_parts(
        spark, str(tmp_path / "out"), read, build, ["dataset", "split", "sample_id"], ["prompt"], ["dataset"], {"m": "1"}
    )
    assert found.count() == 50
    # one plan for the schema, one that ran, neither with a shuffle of the examples
    assert len(seen) == 2 and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in seen)


def test_nulls_do_not_hash_alike(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("", "a")], "x string, y string")
    assert rows.select(input_digest(["x", "y"]).alias("d")).distinct().count() == 4


FACTORY = """
LIMIT = {limit}
def helper(batch):
    return [str(min(LIMIT, 3))] * len(batch)
def factory():
    return lambda batch: helper(batch)
"""


def test_a_changed_factory_is_refused(spark, tmp_path, monkeypatch):
    """Also in a module that workers could import, and whatever part of it has changed."""
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(sys, "dont_write_bytecode", True)
    source = tmp_path / "changing_scorer.py"
    source.write_text(FACTORY.format(limit=1))
    module = importlib.import_module("changing_scorer")
    register_pickle_by_value(module)
    path = str(tmp_path / "out")
    evaluate(spark, responses(spark, range(3)), Model("t/m", module.factory, ("prompt_text",)), path)
    first = code_digest(module.factory)
    source.write_text("\n\n# moved down\n" + FACTORY.format(limit=1))
    assert code_digest(importlib.reload(module).factory) == first
    source.write_text(FACTORY.format(limit=22))
    changed = importlib.reload(module).factory
    assert code_digest(changed) != first
    with pytest.raises(ValueError, match="differs in scorer"):
        evaluate(spark, responses(spark, range(3)), Model("t/m", changed, ("prompt_text",)), path)
    with pytest.raises(ValueError, match="version"):
        evaluate(spark, responses(spark, range(3)), Model("t/m", changed, ("prompt_text",), version="2"), path)


def test_digests_see_closures_and_defaults():
    def made(value, default=1):
        def inner(batch, by=default):
            return [value] * len(batch)

        return inner

    assert code_digest(made(1)) == code_digest(made(1))
    assert len({code_digest(f) for f in (made(1), made(2), made(1, 2), made("1"))}) == 4
