"""Every registered query against its SQL, over whole test tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from scorelane.plans.evaluation import ready
from scorelane.suite import ORACLES, QUERIES, data

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, folder, name):
    frame = contract.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    found = [tuple(row) for row in frame.select(*columns).collect()]
    sql = contract.oracle_sql()[name]
    described = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {column: TYPES[kind] for column, kind in frame.dtypes} == described
    listed = ", ".join(f'"{column}"' for column in columns)
    expected = duck.execute(f"SELECT {listed} FROM ({sql})").fetchall()
    assert found and ordered(found) == ordered(expected)


def test_arrays_hold_whole_texts_and_vectors(spark, duck, folder):
    """Padding adds zeros and loses nothing: what is held is what the tables have."""
    letters = """SELECT sum(length(text)
      - (length(text) - length(replace(text, ' ', ''))) - CAST(contains(text, chr(10)) AS INT)) FROM documents"""
    padded = contract.queries()["padded_prompts"](spark, folder).collect()
    assert sum(r.held for r in padded) == duck.execute(letters).fetchone()[0]
    values = duck.execute("SELECT sum(len(embedding)) FROM embeddings").fetchone()[0]
    frames = contract.queries()["collated_batches"](spark, folder).collect()
    assert sum(int(n) for r in frames for part in r.input_ids.split(";") for n in part.split(",")) == values
    masks = contract.queries()["length_masks"](spark, folder).collect()
    words = """SELECT sum(len(string_split(split_part(text, chr(10), 1), ' ')) + CASE WHEN contains(text, chr(10))
      THEN len(string_split(substr(text, strpos(text, chr(10)) + 1), ' ')) ELSE 0 END) FROM documents"""
    assert sum(r.own for r in masks) == duck.execute(words).fetchone()[0]


def test_every_response_is_answered(spark, folder):
    """No dataset or split is cut: there is an answer for each response, unless a limit is asked for."""
    keys = ["dataset", "split", "sample_id"]
    asked = sorted(tuple(r) for r in data.responses(spark, folder).select(*keys).collect())
    for name in ("all_single_answers", "single_answers"):
        found = contract.queries()[name](spark, folder).select(*keys).collect()
        assert sorted(tuple(r) for r in found) == asked
    limited = ready(data.responses(spark, folder), 40).groupBy("dataset", "split").count()
    assert {r["count"] for r in limited.collect()} == {40}


def test_entry_has_rows(spark, folder):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize(
    "name",
    ["pair_metrics", "shards", "collated_batches", "chat_prompt_parts", "examples_with_hints",
     "converted_results", "cascade_metrics"],
)
def test_results_do_not_depend_on_partitions(spark, folder, name):
    """One shuffle partition or many, broadcast joins or none: the rows are the same."""
    found = []
    for partitions, broadcast in (("1", "10MB"), ("13", "-1")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            found.append(ordered(tuple(r) for r in contract.queries()[name](spark, folder).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


def test_small_files_lie_in_one_folder(spark, folder, tmp_path):
    """A folder for each file is what the driver moves and lists one by one."""
    from scorelane.suite import reading

    path = tmp_path / "maps"
    reading._foreign_maps(spark, folder, str(path))
    assert not [p for p in path.iterdir() if p.is_dir()]
    assert len(list(path.glob("*.json"))) > 1
