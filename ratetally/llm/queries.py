"""The queries of this package over the given tables, and the SQL that must return the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratetally.llm.common import stored, word_count
from ratetally.llm.exact import exact_dedup
from ratetally.llm.jaccard import jaccard_join
from ratetally.llm.lines import line_dedup
from ratetally.llm.mixing import mix
from ratetally.llm.negatives import hard_negatives
from ratetally.llm.packing import pack_documents
from ratetally.llm.quality import score, train
from ratetally.llm.spelling import spelling_groups, vocabulary
from ratetally.llm.substrings import substring_dedup
from ratetally.llm.suffixes import text_dedup
from ratetally.llm.tokens import section_tokens
from ratetally.llm.urlrules import filter_urls
from ratetally.llm.vectors import near_vectors

LISTED_URLS = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"), keep="max")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(text) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
WINDOW same AS (PARTITION BY text)
"""


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, folder, "labels"))).drop("text")


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), k=4, percent=85)


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), 0.9)


def with_digest(out: DataFrame) -> DataFrame:
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return with_digest(substring_dedup(table(spark, folder, "documents"), window=13))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = stored(table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sizes).drop("source")


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w FROM src),
level AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER low, 0) AS left_over,
    sum(w) OVER () - coalesce(sum(w) OVER low, 0) AS free
  FROM weighed WINDOW low AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, left_over * w / free::DOUBLE > cap AS over FROM level),
rest AS (
  SELECT (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM src) - coalesce(sum(cap) FILTER (over), 0) AS left_over,
    sum(w) FILTER (NOT over) AS free FROM capped),
goal AS (SELECT c.source, c.source_size, CASE WHEN c.over THEN c.cap ELSE r.left_over * c.w / r.free::DOUBLE END AS target FROM capped c, rest r),
times AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM goal),
want AS (SELECT *, floor(target + 0.5)::BIGINT - times * source_size AS want FROM times),
placed AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.times, w.want,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', d.doc_id::VARCHAR)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN want w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, want - before)))::BIGINT AS taken FROM placed
"""


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), LISTED_URLS)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return with_digest(line_dedup(table(spark, folder, "documents")))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(vocabulary(table(spark, folder, "documents"), every=31))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))::BIGINT[] AS b
  FROM counted),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS c FROM pairs),
formed AS (
  SELECT w.word, w.n, coalesce(r.c, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END::BIGINT AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
walk AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NULL)
SELECT f.*, coalesce(e.root, f.word) AS root FROM formed f LEFT JOIN ends e ON f.word = e.word
"""


def op12_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = text_dedup(table(spark, folder, "documents"), window=100)
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM scored JOIN positive USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_quality_classifier, op3_ngram_jaccard, op4_embedding_near_dedup, op5_substring_dedup,
    op6_packing, op7_mixing, op8_token_counts, op9_url_filter, op10_line_dedup, op11_spelling_variants, op12_suffix_array_dedup,
    op13_hard_negatives,
)}
SQL = {"op1_exact_dedup": OP1_SQL, "op7_mixing": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op13_hard_negatives": OP13_SQL}
