import random
import re
from collections import Counter

from scorelane.llm.common import table
from scorelane.llm.licences import PHRASES, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    """Words, places of phrases and their labels, by looking at every place."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    places = [
        (at, label)
        for phrase, label in PHRASES
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    starts = [at for at, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def assert_base(documents):
    found = scan(documents).collect()
    expected = Counter((r.doc_id, *base(r.text)) for r in documents.select("doc_id", "text").collect())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert Counter(tuple(r[n] for n in names) for r in found) == expected
    for r in found:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    return {r.doc_id: r for r in found}


def test_phrases_in_random_texts(spark):
    chance = random.Random(1)
    words = "gnu general public license apache cc by mit GNU the Licence, licensé cc-by MIT-License of".split()
    rows = [(i, chance.choice([" ", ", ", "\n"]).join(chance.choice(words) for _ in range(chance.randrange(40)))) for i in range(400)]
    assert_base(spark.createDataFrame(rows, "doc_id long, text string"))


def test_notices_with_words_put_in_and_left_out(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    words = notice.split()
    texts = [
        notice,
        " ".join(words[:6] + ["really"] + words[6:]),
        " ".join(words[:8] + words[9:]),
        " ".join(words[:5]),
        " ".join(reversed(words)),
        "x " * 500 + notice + " y" * 500,
        "Licensed under CC BY-NC 4.0.",
        "All rights reserved.",
        "Permission of the hereby granted person " * 20,
    ]
    found = assert_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [found[i].labels for i in range(9)] == ["mit", "mit", "mit", "", "", "mit", "cc-by,cc-by-nc", "all-rights-reserved", ""]


def test_lists_of_notices(spark):
    """A place of a template counts once, and what stands beside a notice does not hide it."""
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    words = notice.split()
    texts = [
        "CC BY, CC BY-SA",
        "CC BY or CC BY",
        "CC BY-NC, CC BY-ND, CC BY-SA",
        "CC BY CC BY CC BY CC BY",
        "free of charge free of charge free of charge free of charge " + notice + " a copy of a copy of this copy of this",
        "hereby granted granted " * 3 + " ".join(words[:6] + ["really"] + words[6:]) + " this software of this software",
        "free of charge " * 12,
    ]
    found = assert_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [found[i].labels for i in range(7)] == [
        "cc-by,cc-by-sa", "cc-by", "cc-by,cc-by-nc,cc-by-nd,cc-by-sa", "cc-by", "mit", "mit", "",
    ]
    assert [found[i].score for i in range(7)] == [1, 1, 1, 1, 1, found[5].score, 0]


def test_documents_of_the_table(spark, folder):
    assert_base(table(spark, folder, "documents"))


def test_odd_documents(odd_documents, no_documents):
    assert_base(odd_documents)
    assert scan(no_documents).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = scan(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def labels_of(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(scan(frame, **how).collect(), key=lambda r: r.doc_id)]


def test_the_longest_of_nested_notices_counts(spark):
    texts = [
        "CC BY-NC-SA 4.0", "CC BY-NC 4.0 and CC BY-NC-SA 4.0", "Attribution-NonCommercial-NoDerivatives",
        "This Source Code Form is subject to the terms of the Mozilla Public License", "Mozilla Public License",
        "released into the public domain, and: This is free and unencumbered software released into the public domain.",
    ]
    assert labels_of(spark, texts) == [
        "cc-by,cc-by-nc-sa", "cc-by,cc-by-nc,cc-by-nc-sa", "cc-by-nc-nd", "mpl", "mpl", "public-domain,unlicense",
    ]


def test_templates_of_a_table_and_longer_grams(spark):
    """A whole text as a template, words changed in it, and one of a single word."""
    chance = random.Random(3)
    licence = [f"{chance.choice('abcdefgh')}{chance.randrange(60)}" for _ in range(400)]
    changed = [w if at % 40 else "other" for at, w in enumerate(licence)]
    rows = [(" ".join(licence), "own"), ("Xyzzy", "one"), ("first second third", "three"), ("Xyzzy", "one"), ("", "none")]
    table = spark.createDataFrame(rows, "text string, label string")
    texts = [
        "before " + " ".join(licence).upper() + " after", " ".join(changed), " ".join(licence[:150]),
        " ".join(sorted(licence)), "say xyzzy", "first second third", "first second", "MIT License", "",
    ]
    for k in (2, 3, 5):
        found = labels_of(spark, texts, notices=table, k=k)
        assert found == ["own", "own", "", "", "one", "three", "", "mit", ""], k


def test_grams_of_three_find_the_fixed_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    assert labels_of(spark, [notice, "GNU General Public License", "all rights reserved"], k=3) == [
        "mit", "gpl", "all-rights-reserved"
    ]
