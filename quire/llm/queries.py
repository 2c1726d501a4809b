"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, line_join, mixing, packing, quality, sentence_spans, simhash, suffix, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"))
    chunks = warc.read_warc(spark, manifest, with_data=False)
    last = chunks.where("last")
    return last.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "agrees")


def op3_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeated_sentences(_table(spark, sf_dir, "documents"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.dedup_lines(_table(spark, sf_dir, "documents"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op8_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_cube_mixing, op2_warc_chunks, op3_bin_slack_packing, op4_sentence_spans, op5_simhash_pivots, op6_line_edit_join, op7_rule_ledger, op8_pretoken_counts, op9_suffix_dedup, op10_additive_ann)}

_RULES = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(quality.RULES))

ORACLE_SQL = {
    "op2_warc_chunks": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= {warc.LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY t) END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to, true AS agrees
FROM r""",
    "op4_sentence_spans": rf"""
WITH parts AS (
  SELECT doc_id, t, p, k, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(p) AS pos FROM (
    SELECT doc_id, t, unnest(x) AS p, generate_subscripts(x, 1) AS k FROM (
      SELECT doc_id, t, string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]', '\1' || chr(10), 'g'), chr(10)) AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))),
s AS (
  SELECT *, row_number() OVER d AS n, sum(words) OVER d AS total, lead(start) OVER d AS behind FROM (
    SELECT doc_id, t, k, CAST(pos + length(p) - length(ltrim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS BIGINT) AS start,
           array_to_string(regexp_extract_all(p, '[^\x20\x09-\x0D]+'), ' ') AS shown, len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) AS words
    FROM parts WHERE regexp_matches(p, '[^\x20\x09-\x0D]'))
  WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
ahead AS (
  SELECT a.doc_id, a.n AS i, greatest(b.n, a.n + {sentence_spans.RUN - 1}) AS j FROM (SELECT doc_id, n, total - words + {sentence_spans.MIN_WORDS} AS goal FROM s) a
  ASOF JOIN (SELECT doc_id, n, total FROM s) b ON a.doc_id = b.doc_id AND a.goal <= b.total),
back AS (
  SELECT a.doc_id, least(b.n, a.n - {sentence_spans.RUN - 1}) AS i, a.n AS j FROM (SELECT doc_id, n, total - {sentence_spans.MIN_WORDS} AS goal FROM s) a
  ASOF JOIN (SELECT doc_id, n, total - words AS before FROM s) b ON a.doc_id = b.doc_id AND a.goal >= b.before),
runs AS (
  SELECT doc_id, i, j FROM ahead JOIN (SELECT doc_id, max(n) AS last FROM s GROUP BY doc_id) USING (doc_id) WHERE j <= last
  UNION SELECT doc_id, i, j FROM back WHERE i >= 1
  UNION SELECT doc_id, n, n FROM s WHERE words >= {sentence_spans.LONG}),
texts AS (SELECT r.doc_id, i, j, string_agg(shown, chr(1) ORDER BY n) AS x FROM runs r JOIN s ON r.doc_id = s.doc_id AND s.n BETWEEN i AND j GROUP BY ALL),
later AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS place FROM texts),
gone AS (SELECT DISTINCT s.doc_id, s.n FROM later l JOIN s ON l.doc_id = s.doc_id AND s.n BETWEEN l.i AND l.j WHERE place > 1),
marked AS (SELECT s.*, g.n IS NOT NULL AS out, lag(g.n) OVER (PARTITION BY s.doc_id ORDER BY s.n) IS NOT NULL AS out_before FROM s LEFT JOIN gone g USING (doc_id, n)),
kept AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT out_before) AS n_spans,
         min(substr(t, 1, start - 1)) FILTER (n = 1) || coalesce(string_agg(substr(t, start, coalesce(behind, length(t) + 1) - start), '' ORDER BY n) FILTER (NOT out), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes,
       CAST(octet_length(encode(t)) - octet_length(encode(coalesce(kept, t))) AS BIGINT) AS n_bytes_removed, coalesce(kept, t) AS kept
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) LEFT JOIN kept USING (doc_id)""",
    "op7_rule_ledger": f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, CAST({_RULES} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & {quality.BASE} <> 0 AS base_failed,
       fail_bits & {quality.BASE | quality.POLICIES[quality.PRODUCTION]} = 0 AS kept,
       fail_bits, '{quality.PRODUCTION}' AS policy
FROM b""",
}
