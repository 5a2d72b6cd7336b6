from collections import Counter

import corpus_pipeline
from scorelane.llm.common import table
from scorelane.llm.cuckoo import exact_groups
from scorelane.llm.mixing import mix
from scorelane.llm.quality import quality
from scorelane.llm.similar import similar_groups
from tests.llm.test_packing import assert_packed
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.01"


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        found = stage(spark, docs, FOLDER)
        path = str(tmp_path / str(number))
        found.write.parquet(path)
        after = spark.read.parquet(path)
        kept = after.collect()
        if name == "packing":
            # Documents that the mix takes twice are packed twice.
            pieces = Counter((r.doc_id, r.start, r.ids_crc32) for r in kept)
            copies = Counter(r.doc_id for r in rows)
            assert all(n == copies[doc] for (doc, *_), n in pieces.items())
            once = docs.dropDuplicates(["doc_id"])
            assert_packed(
                Tokenizer.from_file(corpus_pipeline.WORD_BPE), once.collect(), stage(spark, once, FOLDER).collect()
            )
            break
        assert after.columns == docs.columns
        by_id = {r.doc_id: r for r in rows}
        assert all(r == by_id[r.doc_id] for r in kept)
        if name == "quality":
            good = {r.doc_id for r in quality(docs, labels).collect() if r.predicted}
            assert {r.doc_id for r in kept} == good and len(kept) == len(good) < len(rows)
        elif name == "exact dedup":
            assert {r.doc_id for r in kept} == {r.keep_id for r in exact_groups(docs).collect()}
        elif name == "near dedup":
            assert {r.doc_id for r in kept} == {r.component_id for r in similar_groups(docs).collect()}
        else:
            taken = {r.doc_id: r for r in mix(docs).collect()}
            sent = Counter(r.doc_id for r in kept)
            assert all(r.taken == sent[d] * r["size"] for d, r in taken.items())
        if name.endswith("dedup"):
            assert len(kept) == len({r.doc_id for r in kept})
        docs = after


def test_odd_documents_pass_through(spark, odd_documents, no_documents, tmp_path):
    for documents in (odd_documents, no_documents):
        docs = documents
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.write.mode("overwrite").parquet(str(tmp_path / "out"))


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and found.count()
