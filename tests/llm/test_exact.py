import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelane.llm.cuckoo import CuckooIndex, changes, digests, exact_groups, update
from scorelane.llm.common import staged


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_index_is_a_set(steps):
    index, live = CuckooIndex(), {}
    for insert, i in steps:
        if insert:
            entry = index.insert(key(i))
            assert live.setdefault(i, entry) == entry
        else:
            assert index.delete(key(i)) == (live.pop(i, None) is not None)
    assert all((index.find(key(i)) >= 0) == (i in live) for i in range(301))


def test_index_grows_and_keeps_its_entries():
    index = CuckooIndex()
    entries = {i: index.insert(key(i)) for i in range(20_000)}
    assert index.mask + 1 >= 20_000 / 4
    assert all(index.find(key(i)) == entry for i, entry in entries.items())
    assert not any(index.find(key(i)) >= 0 for i in range(20_000, 25_000))


def test_equal_prints_are_verified():
    """Digests that share their bucket and their print are two entries."""
    one, two = b"\1" * 10 + b"a" * 22, b"\1" * 10 + b"b" * 22
    index = CuckooIndex()
    assert index.insert(one) != index.insert(two)
    assert index.delete(one) and index.find(one) < 0 <= index.find(two)


def expected(documents):
    groups = {}
    for row in documents:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", row.text or "")
        groups.setdefault(hashlib.sha256(text.encode()).hexdigest(), []).append(row.doc_id)
    return Counter(
        (doc, min((d for d in ids if d is not None), default=None), len(ids), digest)
        for digest, ids in groups.items()
        for doc in ids
    )


def test_groups_of_odd_documents(odd_documents):
    for shard in (2, 50_000):
        found = exact_groups(odd_documents, shard).collect()
        rows = odd_documents.collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)
        kept = [r for r in found if r.kept]
        assert len(kept) == len({r.text_sha256 for r in found})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_no_documents(no_documents):
    assert exact_groups(no_documents).count() == 0


def test_index_table_inserts_and_deletes(spark):
    chance = random.Random(4)
    texts = [f"text {chance.randrange(40)}" for _ in range(300)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = staged(digests(documents), "test")
    index = staged(update(None, changes(rows, 4)), "test")
    parted = update(None, changes(rows.coalesce(1).repartition(3), 4, task_digests=1))
    assert sorted(parted.collect()) == sorted(index.collect())
    more = staged(update(index, changes(rows.where("doc_id < 100"), 4)), "test")
    counts = Counter(texts) + Counter(texts[:100])
    name = {text: hashlib.sha256(text.encode()).hexdigest() for text in texts}
    assert {r.digest: r.copies for r in more.collect()} == {name[t]: n for t, n in counts.items()}
    gone = more.where("copies % 2 = 0").select("shard", "digest", "copies")
    one = more.where("copies % 2 = 1").select("shard", "digest", F.lit(1).cast("long").alias("copies"))
    left = {r.digest: r.copies for r in update(more, changes(rows.limit(0), 4), gone.unionByName(one)).collect()}
    assert left == {name[t]: n - 1 for t, n in counts.items() if n % 2 and n > 1}
