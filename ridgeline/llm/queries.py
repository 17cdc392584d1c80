"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import chat, conversation_repair, decontamination, embedding_dedup, filter_audit, fingerprints, line_dedup, mixing, near_join, packing, quality, suffix_dedup, token_files
from ridgeline.llm.common import documents, scratch, ship


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_join.near_duplicates(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = scratch(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path)
    return token_files.digests(spark, path)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scored = quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_decontamination": op12_decontamination,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op8_chat_formatting": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(md5(role || chr(0) || text) ORDER BY pos) AS turns FROM turns GROUP BY conv_id),
apart AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns FROM whole GROUP BY n_turns, turns),
kept AS (
  SELECT * FROM apart a WHERE NOT EXISTS (
    SELECT 1 FROM whole b WHERE b.n_turns > a.n_turns AND list_slice(b.turns, 1, a.n_turns) = a.turns))
SELECT k.conv_id, CAST(floor((t.pos - 1) / 256) AS BIGINT) AS part, CAST(k.n_turns AS BIGINT) AS n_turns,
       CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END
                  || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept k JOIN turns t ON k.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
""",
    "op10_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS bound FROM s),
r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(bound) OVER (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (SELECT source, source_size, least(bound, max(level) OVER () * weight) AS target FROM r),
q AS (
  SELECT doc_id, draw, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) / nullif(target, 0) AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, finish + pass * (source_size / target) AS due FROM q, (VALUES (0), (1), (2)) v(pass) WHERE size > 0 AND target > 0),
m AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY due, draw, doc_id NULLS LAST, pass ROWS UNBOUNDED PRECEDING) AS upto FROM p),
k AS (SELECT doc_id, count(*) AS n FROM m WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, round(target, 6) AS target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id
""",
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN coalesce(w.doc_id > first_id, false) THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, CAST(k.step AS INTEGER) AS step, bits[k.step] AS bit, CAST(list_sum([0] || bits[1:k.step - 1]) AS INTEGER) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) k),
r AS (
  SELECT part, filter_order, step, bit,
         CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
i AS (SELECT item, words, least(len(words), 10) AS size FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item, size, array_to_string(words[k:k + size - 1], ' ') AS span FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT size FROM w),
p AS (
  SELECT row_id, size, k, array_to_string(words[k:k + size - 1], ' ') AS span
  FROM (SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, sizes)),
h AS (SELECT row_id, k, p.size, item FROM p JOIN w ON p.size = w.size AND p.span = w.span),
n AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT row_id, k, size FROM h)) GROUP BY row_id),
s AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM h) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_id) LEFT JOIN s USING (row_id)
""",
}
