import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelane.llm.common import table
from scorelane.llm.quality import (
    COLUMNS, accepted, dual_descent, features, log_count_ratios, quality, worker_words,
)


def test_features_are_indicators():
    words = worker_words()
    assert len(features(None, words)) == len(features("", words)) == 0
    once, twice = features("one two", words), features("one two\n one   two", words)
    assert set(once) <= set(twice) and len(set(twice)) == len(twice)
    assert set(features("Aa Aa", words)) != set(features("Aa Bb", words))


def test_ratios_and_descent_find_a_separating_plane():
    chance = random.Random(1)
    good = np.array([chance.random() < 0.7 for _ in range(300)])
    rows = [np.unique([chance.randrange(200) for _ in range(20)] + [1000 if g else 1001]) for g in good]
    ratios = log_count_ratios(rows, good)
    assert ratios[1000] > 2 and ratios[1001] < -2 and not ratios[5000]
    values = [ratios[row].astype(float) for row in rows]
    weights, bias = dual_descent(rows, values, good)
    margins = np.array([v @ weights[r] + bias for r, v in zip(rows, values, strict=True)])
    assert ((margins > 0) == good).all() and len(weights) == COLUMNS


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = quality(documents, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    pairs = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert pairs / (len(good) * len(bad)) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_held_out_labels_change_nothing(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality(documents, labels).collect()) == sorted(quality(documents, turned).collect())


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (9, 1)], 1.0), ([(1, 0), (9, 0)], 0.0)])
def test_odd_documents_and_labels(spark, odd_documents, no_documents, labels, score):
    known = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, quality int")
    found = quality(odd_documents, known).collect()
    assert len(found) == odd_documents.count()
    assert all(r.score == pytest.approx(score) and r.predicted == (r.score >= 0.3) for r in found)
    kept = accepted(odd_documents, known)
    assert kept.schema == odd_documents.schema
    assert kept.count() == (odd_documents.count() if score >= 0.3 else 0)
    assert quality(no_documents, known).count() == 0


def plain_model(rows, good):
    """The classifier once more, with dictionaries and loops."""
    aside = [i for i in range(len(rows)) if i % 5 == 4]
    fitted = [i for i in range(len(rows)) if i % 5 != 4]
    counts = {True: {}, False: {}}
    for i in fitted:
        for column in rows[i]:
            counts[bool(good[i])][column] = counts[bool(good[i])].get(column, 0) + 1
    sums = {label: sum(held.values()) + COLUMNS for label, held in counts.items()}
    ratio = {
        c: math.log((counts[True].get(c, 0) + 1) / sums[True]) - math.log((counts[False].get(c, 0) + 1) / sums[False])
        for c in {*counts[True], *counts[False]}
    }

    def value(row):
        held = {c: ratio.get(c, 0.0) for c in row}
        size = math.sqrt(sum(v * v for v in held.values())) or 1.0
        return {c: v / size for c, v in held.items()}

    values = {i: value(rows[i]) for i in fitted}
    share = sum(bool(good[i]) for i in fitted) / len(fitted)
    weight, bias, dual = {}, 0.0, dict.fromkeys(fitted, 0.0)
    for _ in range(3000):
        for i in fitted:
            y = 1 if good[i] else -1
            most = 1 / (2 * share) if good[i] else 1 / (2 * (1 - share))
            slope = y * (sum(v * weight.get(c, 0.0) for c, v in values[i].items()) + bias) - 1
            new = min(max(dual[i] - slope / (sum(v * v for v in values[i].values()) + 1), 0.0), most)
            step, dual[i] = new - dual[i], new
            for c, v in values[i].items():
                weight[c] = weight.get(c, 0.0) + step * y * v
            bias += step * y

    def margin(row):
        return sum(v * weight.get(c, 0.0) for c, v in value(row).items()) + bias

    margins = [margin(rows[i]) for i in aside]
    ups = sum(bool(good[i]) for i in aside)
    target = [(ups + 1) / (ups + 2) if good[i] else 1 / (len(aside) - ups + 2) for i in aside]
    slope, shift = 1.0, 0.0
    for _ in range(60_000):
        errors = [1 / (1 + math.exp(-(slope * m + shift))) - t for m, t in zip(margins, target, strict=True)]
        slope -= 0.02 * (sum(e * m for e, m in zip(errors, margins, strict=True)) + 1e-3 * slope)
        shift -= 0.02 * sum(errors)
    return lambda row: 1 / (1 + math.exp(-(slope * margin(row) + shift)))


def test_scores_equal_a_plain_version(spark):
    """Ratios, the dual's optimum, the sigmoid and the scores of all documents, on a small table."""
    chance = random.Random(11)
    rows, labels = [], []
    for doc in range(60):
        good = chance.random() < 0.6
        pool = "calm clear plain word text" if good else "buy cheap now click text"
        words = [chance.choice((pool + " some other common stuff").split()) for _ in range(chance.randrange(4, 9))]
        rows.append((doc, " ".join(words)))
        labels.append((doc, int(good)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality(documents, known).collect()}
    order = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    order = [r.doc_id for r in order.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    words = worker_words()
    columns = {doc: features(text, words).tolist() for doc, text in rows}
    score = plain_model([columns[doc] for doc in order], [dict(labels)[doc] for doc in order])
    assert {found[doc].held_out for doc in order} == {False} and len(order) < 60
    for doc, _ in rows:
        assert found[doc].score == pytest.approx(score(columns[doc]), abs=0.03)
        assert found[doc].predicted == (found[doc].score >= 0.3)


def test_several_texts_of_one_id_fit_one_model(spark):
    texts = [(doc % 30, f"text {doc} of {doc % 7} words") for doc in range(90)]
    known = spark.createDataFrame([(doc, doc % 2) for doc in range(30)], "doc_id long, quality int")
    runs = []
    for parts in (1, 7):
        documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        runs.append(sorted((r.doc_id, r.score) for r in quality(documents, known).collect()))
    assert [r[0] for r in runs[0]] == [r[0] for r in runs[1]]
    assert [r[1] for r in runs[0]] == pytest.approx([r[1] for r in runs[1]])
