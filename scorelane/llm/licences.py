"""Licence scans by diagonal voting, in DataFrame functions only.

A document's words give a rolling hash of each ``k`` neighbours (pairs, unless asked
otherwise). The hashes are joined to those of the templates; a hit votes for a diagonal,
the word at which the template would have to start. A phrase is found where all its
k-grams vote for one diagonal. For notices neighbouring diagonals are merged to bands, so that a word
put in or left out does not part a span. A band may be longer than its template, so
it is verified from each of its hits on: a span counts if the hits that are not much
further away than the template is long stand at enough different places of it. A
place that is hit again counts once. Of notices that lie inside one another the longest
counts: CC BY-NC-SA is not also CC BY-NC.

Templates are the fixed ones below or a table of the caller's. Their k-grams are written
first, and broadcast if they are at most 100,000. A document keeps one row through
the join and has its hits beside it, so there is one shuffle, of hits only. K-grams
in which all words are function words vote for nothing.

Defined results: null and empty texts have no words, no places and empty labels;
very long texts are scanned whole, a k-gram at a time; repeated rows and rows with a
null ``doc_id`` are scanned like any other; of equally long notices at one place (ties)
all count; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelane.llm.common import ROW_KEY, identified
from scorelane.session import few

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Sentences of well-known notices and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("as published by the free software foundation either version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("attribution noncommercial", "cc-by-nc"),
    ("attribution sharealike", "cc-by-sa"),
    ("attribution noderivatives", "cc-by-nd"),
    ("attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("attribution noncommercial noderivatives", "cc-by-nc-nd"),
    ("creative commons zero", "cc0"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        "bsd",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        "bsd",
    ),
    (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely",
        "zlib",
    ),
    (
        "this is free and unencumbered software released into the public domain",
        "unlicense",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license",
        "mpl",
    ),
    (
        "you should have received a copy of the gnu general public license along with this program",
        "gpl",
    ),
    ("boost software license", "bsl"),
    ("eclipse public license", "epl"),
    ("server side public license", "sspl"),
)
#: Function words; a pair of them is in every text.
FUNCTION_WORDS = frozenset(
    "a an and any as at be by either for from in into is it may not of on or the this to with you".split()
)
#: How far apart diagonals may be to be one span, the part of a template that a span must
#: cover, and how much longer than it a span may be.
NEAR = 2
COVERED = 0.75
STRETCH = 1.5
K = 2
#: Into how many steps a span's reach is cut, as a window's range has one bound for all templates.
SCALE = 1000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in lower case: runs of 0-9, a-z and whatever is not ASCII.

    ``lower`` also changes other letters. None of them becomes an ASCII letter but
    the kelvin sign, a ``k``, and no phrase has that.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram(parts: Column, size: int) -> Column:
    """The hashes of each ``size`` neighbours of an array of words."""
    count = F.greatest(F.size(parts) - size + 1, F.lit(0))
    slices = [F.slice(parts, 1 + at, count) for at in range(size)]
    if size == 1:
        return F.transform(slices[0], lambda word: F.xxhash64(word))
    if size == 2:
        return F.zip_with(*slices, lambda one, two: F.xxhash64(one, two))
    return F.transform(F.arrays_zip(*(s.alias(f"w{i}") for i, s in enumerate(slices))), lambda x: F.xxhash64(x))


def _idle(parts: Column, size: int) -> Column:
    """For each ``size`` neighbours, whether all are function words."""
    function = F.array(*(F.lit(word) for word in sorted(FUNCTION_WORDS)))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - size),
        lambda at: F.size(F.array_except(F.slice(parts, at + 1, size), function)) == 0,
    )


def _placed(grams: Column) -> Column:
    return F.transform(grams, lambda gram, at: F.struct(at.alias("place"), gram.alias("gram")))


def _fixed(spark, notices) -> DataFrame:
    return spark.createDataFrame(list(notices), "text string, label string")


def _templates(texts: DataFrame, base: bool, k: int) -> DataFrame:
    """The k-grams of templates (``text``, ``label``), one row each; shorter templates have grams of their length."""
    split = texts.select(F.xxhash64("text", "label").alias("template"), "label", words(F.col("text")).alias("held"))
    split = split.where(F.size("held") > 0).distinct()
    every = None
    for size in range(1, k + 1):
        own = F.size("held") >= k if size == k else F.size("held") == size
        marked = split.where(own).select(
            "template", "label", F.lit(base).alias("base"), F.size("held").alias("span"), F.lit(size).alias("k"),
            F.posexplode(
                F.arrays_zip(_gram(F.col("held"), size).alias("gram"), _idle(F.col("held"), size).alias("empty"))
            ).alias("at", "of"),
        )
        chosen = marked.where(~F.col("of.empty")).select(
            "template", "label", "base", "span", "k", "at", F.col("of.gram").alias("gram")
        )
        every = chosen if every is None else every.unionByName(chosen)
    pairs = every.groupBy("template").agg(F.count(F.lit(1)).cast("int").alias("pairs"))
    return every.join(pairs, "template")


def scan(
    documents: DataFrame, phrases=PHRASES, notices=NOTICES, covered: float = COVERED, k: int = K
) -> DataFrame:
    """A row per document: its words, the places of phrases, and labels; see the module.

    ``notices`` are pairs of text and label, or a table with these columns, of whole
    licences if need be. A notice of at least ``k`` words is found by its k-grams, a
    shorter one by all its words; phrases are found by pairs.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    spark = documents.sparkSession
    table = isinstance(notices, DataFrame)
    texts = notices.select("text", "label") if table else _fixed(spark, notices)
    templates = few(_templates(_fixed(spark, phrases), True, 2).unionByName(_templates(texts, False, k)), "templates")
    count = F.size("words")
    sizes = [2] if k == 2 and not table else sorted({1, 2, *range(3, k + 1)})
    grams = [_placed(_gram(F.col("words"), size)) for size in sizes]
    rows = identified(documents.select("doc_id", "text"), "licence-input").select(
        ROW_KEY, "doc_id", words(F.col("text")).alias("words")
    )
    rolled = rows.select(
        ROW_KEY,
        "doc_id",
        count.cast("long").alias("n_words"),
        F.explode_outer(F.concat(*grams) if len(grams) > 1 else grams[0]).alias("of"),
    ).select(ROW_KEY, "doc_id", "n_words", "of.place", "of.gram")
    # A document's first k-gram stays without a hit, for the document's sake.
    hits = (
        rolled.join(templates, "gram", "left")
        .where(F.col("template").isNotNull() | (F.coalesce("place", F.lit(0)) == 0))
        .withColumn("diagonal", F.col("place") - F.col("at"))
        .drop("gram")
        .repartition(ROW_KEY)
    )
    document = [ROW_KEY, "doc_id", "n_words"]
    template = ["template", "label", "base", "span", "k", "pairs"]
    line = Window.partitionBy(*document, *template).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > NEAR
    joined = F.when(F.col("base"), F.col("diagonal")).otherwise(
        F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(line)
    )
    # From each hit as far as a span may reach: places are whole, so half a word more lets in no other.
    reach = F.greatest(F.floor(F.col("span") * STRETCH) - F.col("k") + 0.5, F.lit(0.5))
    within = Window.partitionBy(*document, *template, "band").orderBy("stretch").rangeBetween(0, SCALE)
    spans = (
        hits.withColumn("band", joined)
        .withColumn("stretch", F.col("place") * SCALE / reach)
        .withColumn("cover", F.size(F.collect_set("at").over(within)) / F.col("pairs"))
    )
    place = F.col("base") & (F.col("cover") == 1)
    notice = ~F.col("base") & (F.col("cover") >= covered)
    # A notice inside a longer one is part of it: it ends no later than what began no later.
    ends = F.when(notice, F.col("diagonal") + F.col("span"))
    by_start = Window.partitionBy(*document).orderBy(
        notice.desc_nulls_last(), F.col("diagonal"), F.col("span").desc()
    )
    longest = F.max(F.struct(ends.alias("end"), F.col("span"))).over(
        by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    spans = spans.withColumns({"end": ends, "longest": longest})
    inner = (F.col("longest.end") >= F.col("end")) & (F.col("longest.span") > F.col("span"))
    notice = notice & ~F.coalesce(inner, F.lit(False))
    found = spans.groupBy(*document).agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        F.collect_set(F.when(place, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(place | notice, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(place | notice, F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort("labels"), ",").alias("labels"),
        "score",
    )
