"""The corpus operators' registered queries, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, jaccard, licenses, mixing, quality, token_counts, urls, warc
from .common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(urls.labelled_pages(_table(spark, sf_dir, "pages")), bad_col="bad")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ids=False, decoded=False)


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "license", F.array_join("licenses", ",").alias("licenses"), "n_paragraphs")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_exclaims", "n_lines", "failures")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(chat.events_of(rows.unionByName(more))))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does by itself, from a stored ledger of all documents."""
    return quality.ablations(stored(quality.ledger(quality.measure(_table(spark, sf_dir, "documents"))), "ledger"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by source: its size, target and whether the words taken are within its longest document of the target."""
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    near = F.abs(F.sum("taken") - F.first("target")) <= F.max("size")
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.round(F.first("target"), 3).alias("target"), near.alias("near"))


def mixing_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong to their source and their language at once, mixed: size and whole passes by membership pattern."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("source "), "source"), F.concat(F.lit("lang "), "lang")).alias("sources"), mixing.words_of(F.col("text")).alias("size"))
    mixed = mixing.mix_overlapping(rows)
    return mixed.groupBy(F.array_join("sources", "|", "null").alias("pattern")).agg(F.count("*").alias("docs"), F.sum("size").alias("size"), F.sum(F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_bpe_codec, op3_warc_normaliser, op4_token_counts, op5_embedding_neardup, op6_license_scan, op7_ngram_join, op8_quality_rules, op9_chat_format, op10_mixing, quality_ablations, mixing_targets, mixing_overlaps)
}

_LEDGER = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(following - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
         CAST(length(bare) - length(translate(bare, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(bare) - length(translate(bare, '!', '')) AS BIGINT) AS n_exclaims,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT)
    + 4 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS BIGINT) + 8 * CAST(10 * n_symbols > n_words AS BIGINT)
    + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 15 * n_words AS BIGINT)
    + 64 * CAST(4 * n_exclaims > n_words AS BIGINT) AS failures FROM m
)
"""

SQL: dict[str, str] = {
    "op8_quality_rules": _LEDGER
    + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, n_exclaims, n_lines, failures FROM f
""",
    "quality_ablations": _LEDGER
    + r"""
SELECT rule, count(*) FILTER (WHERE failures & b <> 0) AS n_failed, count(*) FILTER (WHERE failures = b) AS n_failed_alone,
       count(*) FILTER (WHERE failures & (127 - b) = 0) AS n_kept_without
FROM f, (VALUES ('few_words', 1), ('repeated_windows', 2), ('repeated_lines', 4), ('many_symbols', 8), ('short_words', 16), ('long_words', 32), ('many_exclamations', 64)) AS r(rule, b)
GROUP BY rule
""",
    "mixing_targets": r"""
WITH n AS (
  SELECT source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, sum(source_size) OVER () AS total FROM s
), f AS (  -- sources are full in the order of size by weight, up to the first that the common level does not fill
  SELECT *, row_number() OVER o AS r, (total - (sum(3 * source_size) OVER o - 3 * source_size)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), g AS (
  SELECT min(r) AS first_open, arg_min(level, r) AS level FROM f WHERE level * weight <= 3 * source_size
)
SELECT source, source_size, round(CASE WHEN r < first_open THEN 3 * source_size ELSE weight * g.level END, 3) AS target, true AS near FROM f, g
""",
    "op5_embedding_neardup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), pair AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(i, j) AS (
  SELECT i, j FROM pair UNION SELECT reach.i, pair.j FROM reach JOIN pair ON reach.j = pair.i
), n AS (SELECT i, count(*) AS n_links FROM pair GROUP BY i), c AS (SELECT i, min(j) AS low FROM reach GROUP BY i)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.i = vec_id LEFT JOIN c ON c.i = vec_id
""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
  )
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\<'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op3_warc_normaliser": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, lpad(array_to_string(list_transform(list_reverse(range(32)),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(sha1(html), CAST(((31 - k) // 8) * 10 + 1 AS INTEGER), 10))::BIGINT >> (5 * (k % 8))) & 31) AS INTEGER) + 1, 1)), ''), 32, 'A') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to FROM d
""",
}
