"""Raw documents to packed sequences: reject, dedup twice, mix, pack.

Every stage takes the documents that its predecessor kept and is written as a
table that the next one reads, so a lost executor costs tasks of one stage only.
All but the last give whole documents with their own columns.

Defined results: nulls, empty and very long texts, ties, repeated rows and clashing
column names are what the operators say of them; rows keep all their columns as they
are; an empty table gives no rows; a null text is an empty document in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelane.llm.common import anchored, identified, select_rows, staged, table
from scorelane.llm.cuckoo import exact_groups
from scorelane.llm.mixing import mixed_documents
from scorelane.llm.packing import pack
from scorelane.llm.quality import accepted
from scorelane.llm.queries import WORD_BPE
from scorelane.llm.similar import similar_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among ``docs``."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return _kept(docs, exact_groups)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that are alike in 0.8 of their five-word shingles.

    The operator's fingerprints give candidates, and so do minima of the shingles; every
    link is verified.
    """
    return _kept(docs, similar_groups)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, in sequences."""
    return pack(docs, WORD_BPE)


def _kept(docs: DataFrame, groups) -> DataFrame:
    docs = anchored(docs)
    verdict = staged(groups(docs), "verdict")
    return select_rows(identified(docs), verdict.where("kept"), docs.columns)


STAGES = [
    ("quality", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no classifier, so the rows are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
