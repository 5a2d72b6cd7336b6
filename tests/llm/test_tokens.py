import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelane.llm.queries import BYTE_BPE
from scorelane.llm.tokens import (
    CountedText, apply_edits, count_states, edited_counts, redactions, segments, worker_count,
)

PATTERN = public_tokenizers.PATTERN
ALPHABET = "ab  é\n\n  '12.,s't  漢\t\xa0"


@pytest.fixture(scope="module")
def count():
    return worker_count(BYTE_BPE, PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.integers(1, 9))
def test_segments_have_the_tokens_of_the_text(count, text, size):
    parts = segments(text, size)
    assert "".join(parts) == text
    assert sum(map(count, parts)) == count(text)


@settings(max_examples=200, deadline=None)
@given(
    st.text(ALPHABET, max_size=150),
    st.lists(st.tuples(st.integers(0, 160), st.integers(0, 40), st.text(ALPHABET, max_size=30)), max_size=8),
    st.integers(1, 9),
)
def test_edits_keep_the_count(count, text, edits, size):
    held = CountedText(text, count, size)
    for at, removed, inserted in edits:
        held.edit(at, removed, inserted)
        at = min(at, len(text))
        text = text[:at] + inserted + text[at + removed :]
        assert (held.text, held.total) == (text, count(text))
        held = CountedText(text, count, size, held.state()) if text else held


def test_an_edit_encodes_its_surroundings_only(count):
    held = CountedText("some words in a row " * 5000, count)
    held.edit(50_000, 4, "other")
    assert held.encoded < 4000 and held.total == count(held.text)


def test_redactions():
    text = "a.42@mail8.example.com 42.144.35.254 x 4041894974608795, 12345678 @ b@c"
    for at, removed, inserted in redactions(text):
        text = text[:at] + inserted + text[at + removed :]
    assert text == "[mail] [address] x [number], 12345678 @ b@c"


def edited(text):
    for at, removed, inserted in redactions(text):
        text = text[:at] + inserted + text[at + removed :]
    return text


def test_counts_of_documents(spark, folder, count, odd_documents, no_documents):
    for documents in (spark.read.parquet(f"{folder}/documents.parquet"), odd_documents):
        texts = {(r.doc_id, r.text) for r in documents.collect()}
        found = {(r.doc_id, r.n_chars, r.tokens_before, r.n_tokens) for r in edited_counts(documents, BYTE_BPE, PATTERN).collect()}
        assert found == {(d, len(t or ""), count(t or ""), count(edited(t or ""))) for d, t in texts}
    assert edited_counts(no_documents, BYTE_BPE, PATTERN).count() == 0


def test_edits_of_kept_states(spark, count, odd_documents):
    chance = random.Random(2)
    documents = odd_documents.where("doc_id NOT IN (1, 8)")
    states = count_states(documents, BYTE_BPE, PATTERN, 64)
    rows = [(d, s, chance.randrange(60), chance.randrange(9), chance.choice(["x y", "", None])) for d in (2, 4, 6, 7, 77) for s in range(5)]
    edits = spark.createDataFrame([*rows, (2, None, 1, 1, "a"), (None, 1, 1, 1, "a")], "doc_id long, step int, at int, removed int, inserted string")
    texts = {r.doc_id: r.text for r in documents.where("doc_id IS NOT NULL").collect()}
    for doc, _, at, removed, inserted in rows:
        if doc in texts:
            text = texts[doc] or ""
            at = min(at, len(text))
            texts[doc] = text[:at] + (inserted or "") + text[at + removed :]
    found = apply_edits(states, edits, BYTE_BPE, PATTERN, 64).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: r.text for r in found} == texts
    assert all(sum(r.tokens) == count(r.text or "") and sum(r.chars) == len(r.text or "") for r in found)
