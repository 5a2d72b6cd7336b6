import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorelane.llm.encoding import WordEncoder
from scorelane.llm.packing import differencing, pack, windows_of
from scorelane.llm.queries import WORD_BPE
from scorelane.llm.common import table


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=200), st.integers(1, 40))
def test_every_length_is_dealt_once(lengths, windows):
    dealt = differencing(lengths, windows)
    assert len(dealt) <= windows
    assert sorted(i for window in dealt for i in window) == list(range(len(lengths)))


def test_windows_are_near_equal_and_few():
    chance = random.Random(1)
    for _ in range(20):
        lengths = [chance.randrange(1, 513) for _ in range(1500)]
        sums = [sum(lengths[i] for i in window) for window in windows_of(lengths, 2048)]
        assert max(sums) <= 2048
        assert len(sums) <= 1.02 * -(-sum(lengths) // 2048) + 1
        assert max(sums) - min(sums) <= 200


def test_two_way_differencing_is_that_of_the_paper():
    dealt = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in window) for window in dealt) == [14, 16]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


ODD_TEXTS = [
    "", "á b", "x ́y", "İstanbul ǅ", "<|endoftext|> hi<|startoftext|>x", "don't  we'll 'sx 'Re a''s",
    "　x y\x1cz\x85w​q", "ΑΣ ΑΣΑ ς", "a\x00b \x1f c", "µ ª º ² ¼½ ÀÞß÷× x_y ¿qué? «x» l'été",
    "\x0b\x0ca\rb", "a\xa0b", "___ $$$ 3.14 12", "\xada", "한 국 漢字",
]


def test_words_are_encoded_like_whole_texts(tokenizer):
    encoder = WordEncoder(WORD_BPE, kept=50)
    for text in ODD_TEXTS:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected, text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abzAZ09é'ÀßÿµªN <|>_-.,!²½\n\t\r\x0b\xa0́¡sS"), max_size=40))
def test_any_text_is_encoded_like_a_whole(tokenizer, text):
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordEncoder(WORD_BPE).encode(text), "<u4").tolist() == expected


def assert_packed(tokenizer, documents, found, capacity=2048):
    """Each document's ids lie in its pieces once, and sequences are gapless and within capacity."""
    expected = defaultdict(list)
    for row in documents:
        expected[row.doc_id].append([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in found:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append((row.offset, row.length))
    assert pieces.keys() == expected.keys()
    for doc, texts in expected.items():
        assert sum(p.length for p in pieces[doc]) == sum(map(len, texts))
        for piece in pieces[doc]:
            assert any(
                piece.doc_tokens == len(ids)
                and zlib.crc32(np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes())
                == piece.ids_crc32
                for ids in texts
            )
        if len(texts) == 1:
            ends = sorted((p.start, p.start + p.length) for p in pieces[doc])
            assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return sequences


def test_odd_documents(tokenizer, odd_documents, no_documents):
    found = pack(odd_documents.coalesce(1), WORD_BPE).collect()
    assert_packed(tokenizer, odd_documents.collect(), found)
    assert pack(no_documents, WORD_BPE).count() == 0


def test_documents_are_packed_tightly(spark, folder, tokenizer):
    documents = table(spark, folder, "documents")
    found = pack(documents, WORD_BPE).collect()
    sequences = assert_packed(tokenizer, documents.collect(), found)
    held = sum(length for parts in sequences.values() for _, length in parts)
    assert held >= 0.98 * 2048 * len(sequences)
    assert found == pack(documents, WORD_BPE).collect()
