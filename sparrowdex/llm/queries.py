"""The registered queries of the operators, each over its whole table, with their SQL where it exists."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip_digests
from .chat_format import CONTROL, FOREIGN, LEARNED_ROLE, format_conversations, read_back
from .cross_polytope import nearest
from .language_id import held_out, identify, train
from .ngram_join import ngram_components
from .pii_crf import pii_spans
from .quality_rules import STOP_WORDS, THRESHOLDS, quality_rules
from .sentence_spans import drop_repeated_spans
from .shared import table
from .soft_mixing import label_sample, soft_mixing
from .token_counts import token_counts

COUNT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CHAT_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONTEXT_TOKENS = 2048


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = train(docs, ~docs["held_out"])
    return identify(docs, model, ["doc_id", "held_out"])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), COUNT_VOCABULARY)
    return counts.withColumn("over_limit", counts["n_tokens"] > CONTEXT_TOKENS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A conversation whose texts are control strings of a template.
PLANTED_CONVERSATION = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_CONVERSATION, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(planted), CHAT_RANKS, public_tokenizers.PATTERN), CHAT_RANKS, public_tokenizers.PATTERN)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"), whole=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


#: Shares of all tokens that the languages of the corpus are to have.
MIX_WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = label_sample(table(spark, sf_dir, "labels"), docs, "lang")
    return soft_mixing(docs, labelled, MIX_WEIGHTS)


def _broken_sql() -> str:
    return " OR ".join(f"({left}) {rel} {bound} * ({right})" for _, left, rel, bound, right in THRESHOLDS)


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS k FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::bigint AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*(?:[-*•]|[0-9]+[.)])[\\x20\\x09]'))) AS n_bullet_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(ws, lambda x: list_contains([{", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS n_stop_words
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_broken_sql()}) AS kept FROM b
"""

CHAT_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, len(regexp_extract_all(role || chr(0) || text, '{"|".join(re.escape(x) for x in ("␛", *CONTROL, *FOREIGN))}')) AS marks FROM r)
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  sum(length(role) + length(text) + marks + {sum(map(len, CONTROL))})::bigint AS formatted_chars
FROM k GROUP BY conv_id
"""

#: Copies are one node; all pairs of nodes that share a shingle are counted, and components spread from smaller ids.
COMPONENTS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END) AS ss FROM d),
k AS (SELECT doc_id, len(ss)::bigint AS n, sha256(array_to_string(list_sort(ss), chr(10))) AS key FROM s),
nodes AS (SELECT key, min(doc_id) AS id, any_value(n) AS n FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY 1),
g AS (SELECT nodes.id, n, hash(unnest(ss)) AS h FROM nodes JOIN s ON s.doc_id = nodes.id),
c AS (SELECT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM c WHERE 100 * shared >= 80 * (nx + ny - shared)),
t AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT id, id AS root FROM nodes UNION SELECT t.y, r.root FROM r JOIN t ON t.x = r.id AND r.root < t.y),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id FROM k LEFT JOIN nodes ON nodes.key = k.key LEFT JOIN m ON m.id = nodes.id
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_nearest": op3_nearest,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op7_pii_spans": op7_pii_spans,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_soft_mixing": op10_soft_mixing,
}

ORACLE_SQL = {"op2_ngram_join": COMPONENTS_SQL, "op5_quality_rules": QUALITY_SQL, "op6_chat_format": CHAT_SQL}
