import hashlib
import zlib

import pytest

from scorelane.llm.common import identified
from scorelane.llm.manifest import manifest, with_siblings
from scorelane.llm.order import numbered
from tests.llm.conftest import DOCUMENT

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    count = None if row.n_chars is None else row.n_chars + more
    return joined(*map(field, (row.doc_id, row.source, row.lang, count, row.text)))


def levels_of(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def path(levels, place, fanout):
    """(digests before, digests after) of a node's run on each level."""
    found = []
    for level in levels[:-1]:
        start = place - place % fanout
        run = level[start : start + fanout]
        found.append((run[: place - start], run[place - start + 1 :]))
        place //= fanout
    return found


def by_rule(rows, fanout):
    branches = {}
    for row in rows:
        branches.setdefault(row.lang, []).append(row)
    names = sorted(branches, key=lambda name: (name is not None, (name or "").encode()))
    trees = []
    for name in names:
        branches[name].sort(key=lambda row: (row.doc_id is not None, row.doc_id or 0, leaf(row)))
        trees.append(levels_of([leaf(row) for row in branches[name]], fanout))
    top = levels_of([tree[-1][0] for tree in trees], fanout)
    found = []
    for number, name in enumerate(names):
        for place, row in enumerate(branches[name]):
            steps = path(trees[number], place, fanout) + path(top, number, fanout)
            chosen = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            fold = leaf(row, 1 if chosen else 0)
            for before, after in steps:
                fold = joined(*before, fold, *after)
            proof = joined(*(digest for before, after in steps for digest in before + after))
            root = top[-1][0]
            found.append((row.doc_id, leaf(row), trees[number][-1][0], root, proof, fold, fold == root))
    return found


def found_in(documents, fanout=2):
    return sorted(map(str, (tuple(r) for r in manifest(documents, fanout).select(*COLUMNS).collect())))


@pytest.mark.parametrize("fanout", [2, 3])
def test_odd_documents(odd_documents, fanout):
    assert found_in(odd_documents, fanout) == sorted(map(str, by_rule(odd_documents.collect(), fanout)))


@pytest.mark.parametrize("fanout", [2, 5])
def test_test_documents(spark, folder, fanout):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    expected = by_rule(documents.collect(), fanout)
    assert found_in(documents, fanout) == sorted(map(str, expected))
    assert not all(row[-1] for row in expected)


def test_no_documents_and_one(spark, no_documents):
    assert manifest(no_documents).count() == 0
    one = spark.createDataFrame([(3, "text", "en", "a", 4)], DOCUMENT)
    assert found_in(one) == sorted(map(str, by_rule(one.collect(), 2)))


def test_a_tampered_row_does_not_verify(spark):
    rows = [(i, f"text {i}", "en", "a", None if i % 2 else i) for i in range(60)]
    documents = spark.createDataFrame(rows, DOCUMENT)
    for row in manifest(documents).collect():
        tampered = zlib.crc32(str(row.doc_id).encode()) % 7 == 0 and row.doc_id % 2 == 0
        assert row.verified is not tampered


def test_fanout_is_checked(no_documents):
    with pytest.raises(ValueError, match="fanout"):
        manifest(no_documents, 1)


def test_both_ways_to_find_siblings_agree(spark):
    nodes = spark.createDataFrame([("a", i, bytes([i]) * 4) for i in range(7)], "branch string, place long, digest binary")
    three = {r.place: (bytes(r.before), bytes(r.after)) for r in with_siblings(nodes, 3).collect()}
    assert three[4] == (b"\x03" * 4, b"\x05" * 4) and three[6] == (b"", b"")
    two = {r.place: (bytes(r.before), bytes(r.after)) for r in with_siblings(nodes).collect()}
    assert two[4] == (b"", b"\x05" * 4) and two[5] == (b"\x04" * 4, b"") and two[6] == (b"", b"")


def test_places_of_a_group_over_many_tasks(spark):
    """A group with most of the rows is dealt to many ranges, and still numbered without a gap."""
    rows = spark.range(3000).selectExpr("if(id < 2900, 'a', concat('b', id % 30)) AS g", "id * 7919 % 3001 AS k")
    rows = identified(rows)
    found = numbered(rows, "g", ["k", rows.columns[-1]], "test-places").collect()
    groups = {}
    for row in found:
        groups.setdefault(row.g, []).append((row.k, row.place))
    for held in groups.values():
        held.sort()
        assert [place for _, place in held] == list(range(len(held)))
