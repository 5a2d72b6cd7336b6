import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from scorelane.llm.mixing import mix, mixed_documents, targets


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]


def target_by_rounds(sizes):
    """Targets by dealing, stopping what is above twice its size, and dealing the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, found = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            found |= {s: left * weight[s] / total for s in open_}
            break
        found |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return found


def test_targets(spark):
    chance = random.Random(1)
    for count in (1, 2, 7, 40):
        sizes = {f"s{i}": chance.choice([0, 1, 50, 1000, 9000]) for i in range(count)} | {None: 300}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in targets(frame).collect()}
        assert found == pytest.approx(target_by_rounds(sizes))


def by_rule(rows):
    """Words taken of each document: the hash order of a source, up to the document nearest its target."""
    sizes, total = sizes_of(rows), defaultdict(int)
    for r, size in zip(rows, sizes, strict=True):
        total[r.source] += size
    target = target_by_rounds(total)
    taken = [0] * len(rows)
    for source in total:
        held = [i for i, r in enumerate(rows) if r.source == source]
        if not total[source]:
            continue
        whole = int(target[source] // total[source])
        extra = target[source] - whole * total[source]
        order = sorted(held, key=lambda i: hashlib.md5(str(rows[i].doc_id).encode()).hexdigest()[:15])
        before, open_ = 0, extra > 0
        for i in order:
            more = open_ and (before + sizes[i] <= extra or before + sizes[i] - extra < extra - before)
            open_ = open_ and before + sizes[i] <= extra
            before += sizes[i]
            taken[i] = sizes[i] * (whole + more)
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_of_whole_documents(spark, seed):
    chance = random.Random(seed)
    rows = [
        (i, " ".join("w" * chance.randrange(1, 5) for _ in range(chance.choice([0, 1, 9, 80, 600]))), chance.choice("abcde"))
        for i in range(250)
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows = documents.collect()
    found = {r.doc_id: r for r in mix(documents).collect()}
    assert [found[r.doc_id].taken for r in rows] == by_rule(rows)
    assert [found[r.doc_id].size for r in rows] == sizes_of(rows)
    sent = Counter(r.doc_id for r in mixed_documents(documents).collect())
    assert all(found[r.doc_id].taken == n * found[r.doc_id].size for r in rows if (n := sent[r.doc_id]) or True)


def test_repeated_rows_are_told_apart(spark):
    """One id with most of a source: its copies are taken until the target is met."""
    rows = [(1, "a b c", "s")] * 300 + [(i, "d e", "s") for i in range(2, 50)] + [(99, "x " * 500, "t")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(documents).collect()
    for source in (996, 500):
        held = [r for r in found if r.source_size == source]
        assert abs(sum(r.taken for r in held) - held[0].target) <= 1.5 or source == 500
        assert all(r.taken <= 2 * r.size for r in held)
    again = mix(documents).collect()
    assert Counter(found) == Counter(again)


def test_odd_documents(odd_documents):
    rows = odd_documents.collect()
    found = mix(odd_documents).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter(
        (r.doc_id, size) for r, size in zip(rows, sizes_of(rows), strict=True)
    )
    assert all(r.taken <= 2 * r["size"] for r in found)
    sent = mixed_documents(odd_documents)
    assert sent.columns == odd_documents.columns
    assert sum(sizes_of(sent.collect())) == sum(r.taken for r in found)


def test_no_documents(no_documents):
    assert mix(no_documents).count() == 0
    assert mixed_documents(no_documents).count() == 0
