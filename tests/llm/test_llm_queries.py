"""Queries against their SQL over whole test tables, and what all of them return."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from scorelane.llm.queries import ORACLES, QUERIES

CONTRACT = {
    1: ["doc_id", "n_tokens"],
    2: ["page_id", "url", "text", "n_chars"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    5: ["doc_id", "size", "source_size", "target", "taken"],
    6: ["query_id", "rank", "vec_id", "score"],
    7: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    8: ["doc_id", "fingerprint", "component_id"],
    9: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    10: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    11: ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    12: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    13: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}
LONG = (
    "start length ids_crc32 doc_tokens sequence_id offset size source_size taken n_chars group_size payload_bytes "
    "n_words n_base n_removed depth n_convs n_children n_leaves saved_tokens"
)


def test_all_are_registered():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES}
    assert numbers == set(CONTRACT) and {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    assert set(CONTRACT[int(re.match(r"op(\d+)_", name)[1])]) <= set(frame.columns)
    kinds = dict(frame.dtypes)
    assert all(kinds[c] == "bigint" for c in LONG.split() if c in kinds)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, size):
    duck = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/{size}/{table}.parquet'")
    frame = QUERIES[name](spark, f"/root/testdata/{size}")
    columns = sorted(frame.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    found = [tuple(row) for row in frame.select(*columns).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
