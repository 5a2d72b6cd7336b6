"""The operators as queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm.common import table
from scorelane.llm.cuckoo import exact_groups
from scorelane.llm.html import main_text
from scorelane.llm.licences import scan
from scorelane.llm.manifest import manifest
from scorelane.llm.mixing import mix
from scorelane.llm.neighbours import search
from scorelane.llm.packing import pack
from scorelane.llm.prefixes import trie
from scorelane.llm.quality import quality
from scorelane.llm.repeats import deduplicated
from scorelane.llm.simhash import near_groups
from scorelane.llm.tokens import edited_counts
from scorelane.llm.warc import round_trip

#: Where the tokenizers' files lie; a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL for the same result."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query()
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_BPE)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
    [5, 2, 1][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM s),
r AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS place,
    SUM(source_size) OVER () AS every, SUM(weight) OVER () AS weights
  FROM w),
p AS (
  SELECT *, (1.5::DOUBLE * every - 2 * COALESCE(SUM(source_size) OVER before, 0))
      / (weights - COALESCE(SUM(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM p WHERE 2 * source_size > level * weight ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, LEAST(2.0::DOUBLE * source_size, level * weight) AS target
  FROM w, l),
m AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM t),
c AS (
  SELECT d.doc_id, d.size, m.source_size, m.target, m.whole, m.target - m.whole * m.source_size AS extra,
    SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h) - d.size AS earlier
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN extra > 0 AND earlier <= extra
      AND (earlier + size <= extra OR earlier + size - extra < extra - earlier)
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query(MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query()
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id,
    sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query(EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", F.col("component_id"))


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(COALESCE(html, ''))::BIGINT AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (10 * (i // 8) + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER
          + 1, 1)
      for i in range(32)], '') AS payload_digest
  FROM p),
k AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM k
"""


@query(WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: CRC-32 of a text of ASCII characters.
CRC_SQL = r"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"COALESCE(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(count: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", count, "text"))) + ")"


MANIFEST_SQL = rf"""
WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, COALESCE('=' || lang, '-') AS branch, doc_id, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {CRC_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS altered
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place FROM base),
up AS (
  SELECT branch, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY branch) AS n FROM leaves
  UNION ALL
  SELECT branch, level + 1, place // 2, sha256(h || COALESCE(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY branch ORDER BY place) AS beside FROM up) WHERE n > 1 AND place % 2 = 0),
tops AS MATERIALIZED (
  SELECT branch, h, row_number() OVER (ORDER BY branch) - 1 AS place FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, place, h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(h || COALESCE(beside, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY place) AS beside FROM over) WHERE n > 1 AND place % 2 = 0),
steps AS MATERIALIZED (
  SELECT r, level, l.place >> level AS own, u.h AS beside
  FROM leaves l JOIN up u ON u.branch = l.branch AND u.place = xor(l.place >> level, 1)
  UNION ALL
  SELECT r, 1000 + level, t.place >> level AS own, o.h
  FROM leaves l JOIN tops t ON t.branch = l.branch JOIN over o ON o.place = xor(t.place >> level, 1)),
-- A lone last node is hashed by itself: a step without a sibling.
alone AS (
  SELECT r, u.level, l.place >> u.level AS own, CAST(NULL AS VARCHAR) AS beside
  FROM leaves l JOIN up u ON u.branch = l.branch AND u.place = l.place >> u.level
  WHERE n > 1 AND u.place = n - 1 AND n % 2 = 1
  UNION ALL
  SELECT r, 1000 + o.level, t.place >> o.level AS own, CAST(NULL AS VARCHAR)
  FROM leaves l JOIN tops t ON t.branch = l.branch JOIN over o ON o.place = t.place >> o.level
  WHERE n > 1 AND o.place = n - 1 AND n % 2 = 1),
path AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS step
  FROM (SELECT * FROM steps UNION ALL SELECT * FROM alone)),
fold AS (
  SELECT r, 1 AS step, COALESCE(altered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN own % 2 = 1 THEN beside || f.h ELSE f.h || COALESCE(beside, '') END)
  FROM fold f JOIN path p ON p.r = f.r AND p.step = f.step),
ends AS (SELECT r, arg_max(h, step) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(beside, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r)
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, COALESCE(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = o.h AS verified
FROM leaves l JOIN tops t USING (branch) JOIN over o ON o.n = 1 JOIN ends e ON e.r = l.r
  LEFT JOIN proofs p ON p.r = l.r
"""


@query(MANIFEST_SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


REPEATS_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(text, '[^ 	-
]+'), []) AS words
  FROM documents),
w AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) AS held
  FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM d)),
k AS (SELECT held, MIN(doc_id) AS least FROM w GROUP BY held),
g AS (
  SELECT r, list(DISTINCT i + j) AS gone
  FROM w JOIN k USING (held), range(13) AS t(j)
  WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, COALESCE(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(COALESCE(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@query(REPEATS_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
    strlen(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '') AS said,
    strlen(COALESCE(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC_SQL.format("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
s AS (
  SELECT c.conv_id, p, said, bytes FROM c JOIN t ON t.conv_id = c.base WHERE p < h
  UNION ALL
  SELECT c.conv_id, p, said, bytes FROM c JOIN t ON t.conv_id = c.conv_id WHERE p >= h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d FROM s),
m AS MATERIALIZED (
  SELECT conv_id, d, bytes, sha256(string_agg(sha256(said), '') OVER (PARTITION BY conv_id ORDER BY d)) AS id FROM o
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
n AS MATERIALIZED (
  SELECT id, ANY_VALUE(d) AS depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(bytes) AS bytes
  FROM m GROUP BY id),
e AS MATERIALIZED (
  SELECT DISTINCT a.id, b.id AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
k AS MATERIALIZED (SELECT parent AS id, COUNT(*) AS n_children FROM e GROUP BY parent),
u AS (
  SELECT x.top AS id, SUM(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
    SUM((n_convs - 1) * bytes) AS saved_tokens
  FROM (SELECT DISTINCT a.id AS top, b.id FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d) x
    JOIN n USING (id) LEFT JOIN k USING (id)
  GROUP BY x.top),
f AS (
  SELECT id, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, arg_max(id, d) AS id FROM m GROUP BY conv_id) GROUP BY id)
SELECT n.conv_id, n.depth::BIGINT AS depth, v.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  COALESCE(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  sha256(COALESCE(ends, '')) AS ends_sha256
FROM n JOIN u USING (id) LEFT JOIN k USING (id) LEFT JOIN f USING (id) LEFT JOIN e USING (id)
  LEFT JOIN n v ON v.id = e.parent
"""


@query(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("prefix")
