import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from scorelane.llm import repeats
from scorelane.llm.repeats import Block, Sketch, deduplicated
from tests.llm.conftest import DOCUMENT


def by_rule(rows, size):
    """(doc_id, words, words that go, kept text) by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    order = [(doc is None, doc or 0) for doc, _ in rows]
    least = {}
    for own, at in zip(words, order, strict=True):
        for i in range(len(own) - size + 1):
            key = tuple(own[i : i + size])
            least[key] = min(least.get(key, at), at)
    found = []
    for (doc, _), own, at in zip(rows, words, order, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if least[tuple(own[i : i + size])] < at:
                gone[i : i + size] = [True] * size
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        found.append((doc, len(own), sum(gone), kept))
    return Counter(found)


def found_in(documents, size):
    return Counter(tuple(row) for row in deduplicated(documents, size).collect())


@pytest.mark.parametrize("size", [1, 3, 13])
def test_odd_documents(odd_documents, size):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found_in(odd_documents, size) == by_rule(rows, size)


def test_no_documents(no_documents):
    assert deduplicated(no_documents).count() == 0


def test_passages_in_many_blocks(spark, monkeypatch):
    """Small blocks, slices and pieces: passages cross all of them, and one is in every document."""
    monkeypatch.setattr(repeats, "PIECE", 50)
    chance = random.Random(5)
    passages = [[f"p{n}w{i}" for i in range(chance.randrange(3, 30))] for n in range(12)]
    rows = []
    for doc in range(300):
        words = [f"u{chance.randrange(40)}" for _ in range(chance.randrange(30))]
        for passage in chance.sample(passages, chance.randrange(4)):
            at = chance.randrange(len(words) + 1)
            words[at:at] = passage
        words += [f"common{i}" for i in range(15)]
        rows.append((doc * 37 % 301 if doc % 50 else None, " \n".join(words), "en", "a", 0))
    rows += rows[:10]
    documents = spark.createDataFrame(rows, DOCUMENT).repartition(5)
    whole = repeats.blocks_of
    monkeypatch.setattr(repeats, "blocks_of", lambda docs: whole(docs, 4000))
    monkeypatch.setattr(repeats, "SLICE_CELLS", 500)
    for size in (4, 13):
        assert found_in(documents, size) == by_rule([row[:2] for row in rows], size)


def test_large_ids_keep_their_digits(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2**62 + 1, text, "en", "a", 0), (2**62 + 2, text, "en", "a", 0), (None, text, "en", "a", 0)]
    found = {r.doc_id: r.n_removed for r in deduplicated(spark.createDataFrame(rows, DOCUMENT).coalesce(1)).collect()}
    assert found == {2**62 + 1: 0, 2**62 + 2: 20, None: 20}


def test_blocks_are_bounded(spark):
    rows = [(i, "x" * (1 + i * i % 5000), "en", "a", 0) for i in range(400)]
    blocks, total = repeats.blocks_of(spark.createDataFrame(rows, DOCUMENT), 10_000)
    sizes = blocks.selectExpr("block", "length(text) AS n").groupBy("block").sum("n").collect()
    assert sum(r["sum(n)"] for r in sizes) == total == sum(len(row[1]) for row in rows)
    assert max(r["sum(n)"] for r in sizes) <= 10_000 and len(sizes) < 400


def test_estimates_are_never_too_low():
    """A sketch far too narrow says repeated too often, and never too seldom."""
    chance = np.random.default_rng(1)
    windows = chance.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64)
    windows = np.concatenate([windows, windows[:500]])
    for width in (100, 3500):
        sketch = Sketch(width, slice_cells=64)
        cells = np.unique(sketch.cells(windows[:3000]))
        sent = [sketch.sparse(windows[:2000]), sketch.sparse(windows[2000:])]
        every = np.sort(np.concatenate(sent))
        often = set(every[1:][every[1:] == every[:-1]].tolist())
        assert {int(c) for c in sketch.cells(windows[:500])} <= often
        assert sum(end - start for _, start, end in sketch.slices(cells)) == len(cells)
        if width == 3500:
            assert len(often) < 1500


def test_windows_do_not_cross_documents():
    rows = pd.DataFrame({"doc_id": [1, 2, 0], "none": [False, False, True], "text": ["a b c d", "e f", None]})
    block = Block(rows, 3)
    assert block.at.tolist() == [0, 1] and block.edges.tolist() == [0, 4, 6, 6]
    assert block.order.tolist() == [1, 1]
    assert repeats._unpacked(repeats._packed(block.hashes[0]), np.uint64).tolist() == block.hashes[0].tolist()
