"""Queries of the training-data operators over the given tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, languages
from .common import table
from .lines import drop_boilerplate
from .mixing import mix_sources
from .packing import pack
from .quality import quality_verdicts
from .runs import echoed, periodic_runs, run_digest
from .secrets import find_secrets
from .simhash import near_duplicate_groups
from .tokens import token_counts
from .topk import top_k
from .toxicity import held_out, learn_lexicon, toxicity_scores
from .turns import damaged, repair_reports


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"), train_rows=20_000)
    return toxicity_scores(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with a stale last reply."""
    whole = chat.conversations(table(spark, sf_dir, "conversations"))
    pairs = whole.select("conv_id", F.col("turns").alias("chosen"), chat.stale_reply(F.col("turns")).alias("rejected"))
    made = chat.format_preferences(pairs)
    out = made.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", *[f(F.col(side)).alias(f"{side}{name}") for side in ("chosen", "rejected") for name, f in (("", chat.completion), ("_mask", chat.mask))])
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their documents, as many rows as there are documents."""
    return mix_sources(table(spark, sf_dir, "documents"), exponent=0.5).withColumn("copy", F.col("copy").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_boilerplate(docs, min_sites=3).select("doc_id", "text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.learn_profiles(docs))
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document repeats a passage of its own to its end."""
    return run_digest(periodic_runs(echoed(table(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults by the checksums of their rows."""
    return repair_reports(damaged(table(spark, sf_dir, "conversations")), gone_col="gone")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations),
r AS (SELECT conv_id, rn, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS back, text FROM t WHERE role = 'assistant'),
last AS (SELECT conv_id, max(CASE WHEN back = 1 THEN rn END) AS last_rn, max(CASE WHEN back = 2 THEN text END) AS stale FROM r GROUP BY conv_id),
b AS (SELECT t.*, CASE WHEN rn = last_rn THEN coalesce(stale, '') ELSE text END AS other FROM t LEFT JOIN last USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(CASE WHEN other <> text THEN rn END), max(rn) + 1) - 1 AS prompt_turns FROM b GROUP BY conv_id),
p AS (SELECT b.*, prompt_turns, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body, other || '<|im_end|>' || chr(10) AS body2,
             CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS flag FROM b JOIN n USING (conv_id))
SELECT conv_id, CAST(prompt_turns AS BIGINT) AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY rn) FILTER (WHERE rn <= prompt_turns), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY rn) FILTER (WHERE rn > prompt_turns), '') AS chosen,
  coalesce(string_agg(length(head) || ':0,' || length(body) || flag, ',' ORDER BY rn) FILTER (WHERE rn > prompt_turns), '') AS chosen_mask,
  coalesce(string_agg(head || body2, '' ORDER BY rn) FILTER (WHERE rn > prompt_turns), '') AS rejected,
  coalesce(string_agg(length(head) || ':0,' || length(body2) || flag, ',' ORDER BY rn) FILTER (WHERE rn > prompt_turns), '') AS rejected_mask
FROM p GROUP BY conv_id, prompt_turns
""",
    "op5_mixing": """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, round(pow(CAST(n AS DOUBLE), 0.5) / (SELECT sum(round(pow(CAST(n AS DOUBLE), 0.5), 9)) FROM counts) * (SELECT CAST(sum(n) AS DOUBLE) FROM counts) / n, 12) AS rate FROM counts),
steps AS (SELECT source, rate, 0 AS k, -rate AS p, exp(-rate) AS cumulative FROM rates
          UNION ALL SELECT source, rate, k + 1, p + ln(rate / (k + 1)), cumulative + exp(p + ln(rate / (k + 1))) FROM steps WHERE k < rate + 12 * sqrt(rate) + 40),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT u.doc_id, count(steps.k) AS n FROM u JOIN steps ON u.source = steps.source AND steps.cumulative <= u.u GROUP BY u.doc_id)
SELECT d.*, k.copy, CAST(CAST('0x' || substr(md5('18:' || d.doc_id || ':' || k.copy), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS shuffle_key
FROM documents d JOIN c USING (doc_id) JOIN (SELECT unnest(range(0, (SELECT max(n) FROM c))) AS copy) k ON k.copy < c.n
""",
    "op6_line_dedup": """
WITH a AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM a),
s AS (SELECT bare, min(doc_id) AS keeper FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '')) >= 3)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.bare IS NULL OR l.doc_id = s.keeper), '') AS text
FROM l LEFT JOIN s ON l.bare = s.bare GROUP BY l.doc_id
UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL
""",
    "op9_quality": r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
g AS (SELECT row_id, pos, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
t AS (SELECT row_id, pos, word, third IS NOT NULL AND count(*) OVER (PARTITION BY row_id, word, second, third) > 1 AS again FROM g),
c AS (SELECT row_id, word, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered FROM t WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
f AS (SELECT row_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY row_id),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper FROM d),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, letters, upper FROM l LEFT JOIN f USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * upper > letters OR 2 * letters < word_chars) AS kept
FROM b
""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
