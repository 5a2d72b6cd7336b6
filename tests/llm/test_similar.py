import random
import re
from collections import Counter

import numpy as np
import pytest

from scorelane.llm.common import table
from scorelane.llm.similar import minima, similar_groups
from tests.llm.conftest import DOCUMENT


def shingles(text, words=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1)))


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(rows, least=0.8, common=400):
    """Pairs of documents that are alike, by an index of all but the most common shingles."""
    sets = {doc: shingles(text) for doc, text in rows}
    holders = {}
    for doc, held in sets.items():
        for shingle in held:
            holders.setdefault(shingle, []).append(doc)
    met = Counter()
    for docs in holders.values():
        if 1 < len(docs) <= common:
            for i, a in enumerate(docs):
                for b in docs[i + 1 :]:
                    met[min(a, b), max(a, b)] += 1
    return {(a, b) for (a, b), n in met.items() if n > 1 and similarity(sets[a], sets[b]) >= least}, sets


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_test_documents(spark, size):
    """Of the pairs of unlike texts at 0.8 or more nine in ten meet in a group, and all groups hang together."""
    documents = table(spark, f"/root/testdata/{size}", "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    pairs, sets = alike(rows)
    found = {r.doc_id: r.component_id for r in similar_groups(documents).collect()}
    unlike = [(a, b) for a, b in pairs if sets[a] != sets[b]]
    met = sum(found[a] == found[b] for a, b in unlike)
    assert len(unlike) > 4 and met >= 0.9 * len(unlike)
    same = [(a, b) for a, b in pairs if sets[a] == sets[b]]
    assert all(found[a] == found[b] for a, b in same)
    # no group but by links: each member is alike with another of its group
    groups = {}
    for doc, group in found.items():
        groups.setdefault(group, []).append(doc)
    for held in groups.values():
        for doc in held if len(held) > 1 else []:
            assert any(similarity(sets[doc], sets[other]) >= 0.8 for other in held if other != doc)


def test_a_family_of_near_copies(spark):
    """Each is like the first, and less like each other."""
    chance = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base), "en", "a", 0)]
    for doc in range(1, 60):
        words = list(base)
        for at in chance.sample(range(300), 4):
            words[at] = f"x{doc}"
        rows.append((doc, " ".join(words), "en", "a", 0))
    rows += [(100 + i, " ".join(f"o{i}q{j}" for j in range(50)), "en", "a", 0) for i in range(20)]
    sets = {row[0]: shingles(row[1]) for row in rows}
    near = [doc for doc in range(1, 60) if similarity(sets[0], sets[doc]) >= 0.8]
    found = {r.doc_id: r for r in similar_groups(spark.createDataFrame(rows, DOCUMENT)).collect()}
    assert len(near) > 50 and sum(found[doc].component_id == 0 for doc in near) >= 0.9 * len(near)
    assert all(found[100 + i].kept for i in range(20))
    assert sum(r.kept for r in found.values()) == len({r.component_id for r in found.values()})


def test_odd_documents(odd_documents, no_documents):
    rows = odd_documents.collect()
    found = similar_groups(odd_documents).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows)
    groups = {}
    for r in found:
        groups.setdefault(r.component_id, []).append(r)
    # two texts go by the id 8, and each stays
    assert all(sum(r.kept for r in held) == (2 if group == 8 else 1) for group, held in groups.items())
    by_text = {}
    for row in rows:
        by_text.setdefault(shingles(row.text), set()).add(row.doc_id)
    named = {r.doc_id: r.component_id for r in found if r.doc_id not in (None, 8)}
    for held in by_text.values():
        assert len({named[d] for d in held if d in named}) <= 1
    # the two long texts differ in one word
    assert named[6] == named[7] == 6
    assert similar_groups(no_documents).count() == 0


def test_minima_estimate_the_similarity():
    chance = np.random.default_rng(3)
    hashes = chance.integers(0, 1 << 63, 2000, np.int64).astype(np.uint64)
    one, two = minima(hashes[:1800], 400), minima(hashes[200:], 400)
    assert abs((one == two).mean() - 0.8) < 0.08
    assert minima(np.empty(0, np.uint64), 3).tolist() == [-1, -1, -1]
