"""The operators over the driver tables, one query each, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwatch.llm import (
    bpe_codec,
    byte_cnn,
    curve_packing,
    feistel_pii,
    hilbert_shards,
    license_scan,
    ngram_join,
    nn_descent,
    prefix_trie,
    substring_dedup,
    token_alignment,
    token_counts,
    weighted_sampling,
)

SHARDS = 24
ACCEPTED = 0.7
#: A real run brings its own and keeps it secret.
PII_KEY = "offerwatch"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = hilbert_shards.shards(rows, "doc_id", ["source", "lang", "n_chars", "doc_id"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymise(load(spark, sf_dir, "documents"), "doc_id", "text", PII_KEY)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return curve_packing.pack(load(spark, sf_dir, "documents"), "doc_id", "text", path, digest=True)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(load(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(load(spark, sf_dir, "documents"), "doc_id", "text")


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    net = byte_cnn.fit(docs, load(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    scored = byte_cnn.score(docs, "doc_id", "text", net)
    return scored.select("doc_id", byte_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_against_next(load(spark, sf_dir, "documents"), "doc_id", "text")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.digests(load(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"), "doc_id", "text").drop("k1", "k2")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.deduplicate(load(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = load(spark, sf_dir, "documents"), public_tokenizers.path
    return token_alignment.align(docs, "doc_id", "text", path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(load(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(load(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards,
        op2_feistel_pii,
        op3_curve_packing,
        op4_license_scan,
        op5_substring_dedup,
        op6_byte_cnn,
        op7_weighted_sampling,
        op8_bpe_codec,
        op9_ngram_join,
        op10_nn_descent,
        op11_token_alignment,
        op12_token_counts,
        op13_prefix_trie,
    )
}

ORACLES = {
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
twice AS (
  SELECT doc_id, i FROM win
  WHERE content IN (SELECT content FROM win GROUP BY content HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM twice),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least.b, doc_id)) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       doc_id <= coalesce(least.b, doc_id) AS kept
FROM documents LEFT JOIN least ON least.a = doc_id LEFT JOIN degree ON degree.a = doc_id""",
    "op10_nn_descent": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id""",
    "op13_prefix_trie": r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, digest, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM said),
ids AS (SELECT DISTINCT conv_id FROM own),
crc(conv_id, rest, steps, value) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, CASE WHEN steps = 0 THEN rest[2:] ELSE rest END, (steps + 1) % 9,
         CASE WHEN steps = 0 THEN xor(value, ascii(rest)::BIGINT)
              WHEN value % 2 = 1 THEN xor(value // 2, 3988292384::BIGINT) ELSE value // 2 END
  FROM crc WHERE steps > 0 OR rest <> ''),
h AS (SELECT conv_id, xor(value, 4294967295::BIGINT) % 6 AS h FROM crc WHERE rest = '' AND steps = 0),
ordered AS (
  SELECT h.conv_id, 0 AS half, pos, digest, chars FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % 100 AND pos < h
  UNION ALL SELECT h.conv_id, 1, pos, digest, chars FROM h JOIN own ON own.conv_id = h.conv_id AND pos >= h),
lists AS (SELECT conv_id, list(digest ORDER BY half, pos) AS digests, list(chars ORDER BY half, pos) AS chars FROM ordered GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(digests, []) AS digests, coalesce(lists.chars, []) AS chars FROM ids LEFT JOIN lists USING (conv_id)),
starts AS (
  SELECT conv_id, d, array_to_string(digests[1 : d], '') AS key, array_to_string(digests[1 : d - 1], '') AS up,
         CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, d = len(digests) AS here
  FROM (SELECT *, unnest(range(len(digests) + 1)) AS d FROM whole)),
node AS (
  SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (here), '')) AS ends
  FROM starts GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT DISTINCT a.d, a.key, b.d AS d2, b.key AS key2
  FROM starts a JOIN starts b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT below.d, below.key, count(*) FILTER (kids.n IS NULL) AS leaves, sum((node.n - 1) * node.chars) AS saved
  FROM below JOIN node ON node.d = d2 AND node.key = key2 LEFT JOIN kids ON kids.d = d2 AND kids.key = key2
  GROUP BY 1, 2)
SELECT node.conv_id, node.d AS depth, top.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sums ON sums.d = node.d AND sums.key = node.key
LEFT JOIN kids ON kids.d = node.d AND kids.key = node.key
LEFT JOIN node top ON top.d = node.d - 1 AND top.key = node.up AND node.d > 0""",
}
