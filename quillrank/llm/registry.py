"""Registered queries of the corpus operators, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import bpe, chat, decontam, fingerprint, html_main, langid, lblm, neardup, toxicity, warc
from quillrank.llm._common import fold
from quillrank.runtime import table

BPE_RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_comparison(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 1
    scored = lblm.score(table(spark, sf_dir, "documents"), "doc_id", "text", ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = bpe.encode_decode(docs, "doc_id", "text", public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = langid.fit(docs, "doc_id", "text", "lang", ~held_out, public_tokenizers.path(PIECES))
    return langid.predict(docs, "doc_id", "text", model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.filter(~held_out), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, "doc_id", "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_sample(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.formatted_turns(rows, "conv_id", "turn", "role", "text"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_main.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html", html_main.train())
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_lm_scores, op3_warc, op4_bpe, op5_language_id, op6_toxicity, op7_near_duplicates, op8_chat_format, op9_main_text, op10_decontamination)}

#: Links by counting shared shingles, then the least id reachable.
OP7_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS s
  FROM toks
), coded AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh
), sizes AS (
  SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""

#: The template's marks and escapes, by SQL's own regular expressions.
OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), pieces AS (
  SELECT conv_id, turn, role, text, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '([<\[])(s>|/s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|END\])', '\1\\\2', 'g') AS body,
    regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '([<\[])(s>|/s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|END\])', '\1\\\2', 'g') AS name
  FROM turns
), formatted AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || body || ' [/INST]' WHEN 'assistant' THEN '<s>' || body || '</s>'
    WHEN 'system' THEN '<<SYS>>' || body || '<</SYS>>' ELSE '[ROLE]' || name || '[/ROLE]' || body || '[END]' END AS piece
  FROM pieces
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""

ORACLE_SQL = {"op7_near_duplicates": OP7_SQL, "op8_chat_format": OP8_SQL}
