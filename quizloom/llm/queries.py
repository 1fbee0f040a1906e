"""The queries that apply each operator, with production parameters, to its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.alignment import tokenizer_links
from quizloom.llm.conversations import conversation_report, damaged, repair_conversations
from quizloom.llm.exact_dedup import exact_duplicates
from quizloom.llm.fingerprints import edited_fingerprints
from quizloom.llm.language_id import language_id
from quizloom.llm.line_dedup import dedup_lines
from quizloom.llm.mixing import mix_sources
from quizloom.llm.ngram_join import ngram_jaccard_join
from quizloom.llm.packing import pack_documents
from quizloom.llm.quality import quality_scores
from quizloom.llm.token_count import token_counts
from quizloom.llm.toxicity import toxicity_scores
from quizloom.llm.vector_dedup import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy drawn: doc_id, source, its place in the permutation (epoch, block_order, block, doc_order), n_words, weight."""
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), target_entropy=0.95, max_repetition=4.0)
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_order").alias("block_order"), F.col("_block").alias("block"), F.col("_place").alias("doc_order"), F.col("_tokens").alias("n_words"), F.round("_weight", 6).alias("weight"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_gone, text_sha256 (of the text that is left; null for a null text). Lines of any length go if they repeat exactly."""
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_gone"), F.sha2("text", 256).alias("text_sha256"))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic >= 0.5)."""
    out = toxicity_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    p = F.col("_p")
    return out.select("doc_id", p[0].alias("p_low_quality"), p[1].alias("p_toxic"), (p[1] >= 0.5).alias("toxic"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_links(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_report(repair_conversations(damaged(conversations)), conversations.select("conv_id"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def _sql_draw(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def _sql_bisect(name: str, wanted: str, if_true: str, if_false: str) -> str:
    """35 halvings of [0, 1]; ``wanted`` speaks of sums over the shares p and of the middle a."""
    return f"""{name}(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT step + 1, CASE WHEN {wanted} THEN {if_true}, CASE WHEN {wanted} THEN {if_false}
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS a FROM {name} WHERE step < 35), shares GROUP BY step, lo, hi, a)"""


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tok FROM documents),
t AS (SELECT source, count(*) AS n_docs, sum(tok)::BIGINT AS n_tokens FROM d GROUP BY 1),
total AS (SELECT sum(n_tokens)::BIGINT AS tokens, count(*) FILTER (WHERE n_tokens > 0) AS n FROM t),
shares AS (SELECT n_tokens / tokens::DOUBLE AS p, n FROM t, total WHERE n_tokens > 0),
{_sql_bisect("by_entropy", "ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) >= 0.95 * ln(max(n))", "a ELSE lo END", "hi ELSE a END")},
{_sql_bisect("by_repetition", "max(pow(p, a - 1)) / sum(pow(p, a)) <= 4.0", "lo ELSE a END", "a ELSE hi END")},
x AS (SELECT CASE WHEN (SELECT n FROM total) > 1 THEN greatest((SELECT floor(lo * 1e6 + 1e-3) / 1e6 FROM by_entropy WHERE step = 35), (SELECT ceil(hi * 1e6 - 1e-3) / 1e6 FROM by_repetition WHERE step = 35)) ELSE 1.0 END AS a),
z AS (SELECT sum(pow(p, a)) AS z FROM shares, x),
plan AS (SELECT source, n_tokens, ceil(n_docs / 256)::BIGINT AS blocks, CASE WHEN n_tokens > 0 THEN pow(n_tokens / tokens::DOUBLE, a) / z ELSE 0.0 END AS weight, floor(CASE WHEN n_tokens > 0 THEN pow(n_tokens / tokens::DOUBLE, a) / z ELSE 0.0 END * tokens + 1e-6)::BIGINT AS want FROM t, total, x, z),
cut AS (SELECT d.*, weight, CASE WHEN n_tokens > 0 THEN want // n_tokens ELSE 1 END AS epochs, CASE WHEN n_tokens > 0 THEN want % n_tokens ELSE 0 END AS rest, {_sql_draw("0", "'block'", "doc_id")} % blocks AS block FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
placed AS (SELECT *, sum(tok) OVER (PARTITION BY source ORDER BY {_sql_draw("0", "'order'", "coalesce(source, '')", "block", "epochs")}, block, {_sql_draw("0", "'doc'", "doc_id", "epochs")}, doc_id) AS upto FROM cut),
copies AS (SELECT *, unnest(range(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM placed)
SELECT doc_id, source, epoch, {_sql_draw("0", "'order'", "coalesce(source, '')", "block", "epoch")} AS block_order, block, {_sql_draw("0", "'doc'", "doc_id", "epoch")} AS doc_order, tok AS n_words, round(weight, 6) AS weight FROM copies
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: crc32 of an ASCII text: its bytes folded, eight shifts each.
_SQL_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x // 2, (x % 2) * 3988292384))), 4294967295::BIGINT)"

OP12_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
drawn AS (SELECT *, {_SQL_CRC32} % 20 AS draw FROM keyed),
d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS trimmed,
  CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS ini FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND nth > 1 AS dup, trimmed <> '' AND nth = 1 AND trimmed[-1] NOT IN ('.', '!', '?') AS late, concat(ini, lead(ini) OVER (PARTITION BY conv_id ORDER BY i)) AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM n),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE late) AS truncated, count(*) FILTER (WHERE i < n AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
edit(e, ini, q, q2, cost) AS (VALUES ('D', '-', 0, 0, 3), ('D', '-', 1, 1, 3), ('D', '-', 2, 2, 3), ('D', '-', 3, 3, 3), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0), ('R', '-', 0, 2, 2), ('R', '-', 1, 2, 2), ('R', '-', 2, 3, 2), ('R', '-', 3, 2, 2)),
ins(q, q2, cost, e) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')),
step AS (SELECT f.conv_id, f.i, ins.q, edit.q2, ins.cost + edit.cost + CASE WHEN late AND edit.e <> 'D' THEN 1 ELSE 0 END AS cost, concat(ins.e, edit.e) AS e,
  concat(CASE ins.e WHEN 'I' THEN concat(CASE ins.q2 WHEN 3 THEN 'assistant' ELSE 'user' END, ':', chr(10)) WHEN 'II' THEN CASE ins.q2 WHEN 2 THEN concat('assistant:', chr(10), 'user:', chr(10)) ELSE concat('user:', chr(10), 'assistant:', chr(10)) END ELSE '' END,
    CASE edit.e WHEN 'D' THEN '' WHEN 'K' THEN concat(role, ':', text, chr(10)) ELSE concat(CASE edit.q2 WHEN 3 THEN 'assistant' ELSE 'user' END, ':', text, chr(10)) END) AS said
  FROM f, ins, edit WHERE edit.q = ins.q2 AND (edit.ini = '-' OR edit.ini = f.ini) AND (edit.e = 'D' OR NOT (blank OR dup))),
back(conv_id, i, q, cost, audit, said) AS (
  SELECT conv_id, max(i) + 1, q, c, a, t FROM f, (VALUES (0, 0, '', ''), (1, 4, 'II', concat('user:', chr(10), 'assistant:', chr(10))), (2, 2, 'I', concat('assistant:', chr(10))), (3, 0, '', '')) AS fin(q, c, a, t) GROUP BY conv_id, q, c, a, t
  UNION ALL
  SELECT s.conv_id, s.i, s.q, min(s.cost + b.cost), arg_min(concat(s.e, b.audit), (s.cost + b.cost, concat(s.e, b.audit))), arg_min(concat(s.said, b.said), (s.cost + b.cost, concat(s.e, b.audit)))
  FROM back b, step s WHERE s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1 AND s.q2 = b.q GROUP BY s.conv_id, s.i, s.q)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(CASE WHEN said = '' THEN '' ELSE said[: -2] END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN back b ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1 AND b.q = 0
"""

_SQL_WORDS = r"""list_filter(string_split(translate(t, concat('ABCDEFGHIJKLMNOPQRSTUVWXYZ', chr(9), chr(10), chr(11), chr(12), chr(13)), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '')"""
_SQL_SKETCH = "CASE WHEN len(words) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: substr(md5(array_to_string(words[i : i + 4], ' ')), 1, 12))))[1 : 128] END"


def _sql_near(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat({a}, {b})))[1 : 128]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_filter({both}, lambda x: list_contains({a}, x) AND list_contains({b}, x)))::DOUBLE / len({both}) END"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, {_SQL_SKETCH} AS own FROM (SELECT *, {_SQL_WORDS} AS words FROM d)),
n AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS t2, coalesce(lead(own) OVER o, first_value(own) OVER o) AS own2 FROM f WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, length(t) AS n_chars, own, own2, concat(substr(t, 1, length(t) - length(t) // 2), substr(t2, 1, length(t) // 2)) AS t FROM n),
g AS (SELECT doc_id, n_chars, own, own2, t, {_SQL_SKETCH} AS edited FROM (SELECT *, {_SQL_WORDS} AS words FROM e))
SELECT doc_id, n_chars, sha256(t) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(edited, '') AS edited_fingerprint,
  {_sql_near("own", "edited")} AS near_edited, {_sql_near("own", "own2")} AS near_next FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_mix_sources, op3_line_dedup, op4_pack_documents, op5_token_counts, op6_embedding_near_dedup, op7_toxicity, op8_exact_dedup, op9_ngram_jaccard_join,
        op10_quality, op11_token_alignment, op12_conversation_repair, op13_fingerprints,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op12_conversation_repair": OP12_SQL, "op13_fingerprints": OP13_SQL}
