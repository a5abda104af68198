"""The operators over their whole tables, as registered queries, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.chat import rotate_dialogues
from repochron.llm.common import read
from repochron.llm.context_tree import score_documents
from repochron.llm.decontaminate import decontaminate
from repochron.llm.hard_negatives import mine_hard_negatives
from repochron.llm.jaccard_join import near_duplicates
from repochron.llm.lexical_search import rank_documents
from repochron.llm.mixing import mix_documents
from repochron.llm.page_text import extract_main_text
from repochron.llm.quality_model import score_quality
from repochron.llm.quality_rules import POLICIES, RULES, apply_policy, rule_book
from repochron.llm.sharding import shard_documents
from repochron.llm.toxicity import score_toxicity
from repochron.llm.urls import judge_urls

#: host, path, action
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: share of the tokens that each domain is to have
MIX = {"plain": 0.97, "low": 0.02, "toxic": 0.01}
SHARDS = 40


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS rules(host, path, action)")
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_book(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = apply_policy(apply_policy(book, POLICIES["base"], "base_ok"), POLICIES["v2"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "failed")


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_documents(docs, read(spark, sf_dir, "labels"), MIX, keep_text=False)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard_documents(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), " ")
    return rotate_dialogues(read(spark, sf_dir, "conversations")).withColumn("spans", spans).drop("mask")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    id_ = F.col("vec_id")
    label = F.when(id_ % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine_hard_negatives(vectors, id_ % 50 == 0, label=label).select(
        F.col("anchor_id").cast("long").alias("anchor_id"), F.col("positive_id").cast("long").alias("positive_id"), "rank", F.col("negative_id").cast("long").alias("negative_id"), "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": page_text, "op2_url_filter": url_filter, "op3_decontamination": decontamination, "op4_quality_model": quality, "op5_quality_rules": quality_rules,
    "op6_jaccard_join": jaccard, "op7_mixing": mixing, "op8_sharding": sharding, "op9_context_tree": language_model, "op10_chat": chat,
    "op11_toxicity": toxicity, "op12_lexical_search": lexical_search, "op13_hard_negatives": hard_negatives,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _grams(k: int) -> str:
    """SQL for the runs of ``k`` words that begin at each place of ``words``."""
    later = "".join(f" || ' ' || lead(word, {j}) OVER w" for j in range(1, k))
    return f"SELECT row, i, {k} AS k, word{later} AS gram FROM words WINDOW w AS (PARTITION BY row ORDER BY i)"


ORACLES: dict[str, str] = {
    "op10_chat": r"""
        WITH said AS (
          SELECT conv_id, CAST(coalesce(turn, 0) AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS body FROM conversations),
        numbered AS (
          SELECT *, CAST(floor(turn / 1024.0) AS BIGINT) AS part, row_number() OVER (PARTITION BY conv_id, floor(turn / 1024.0) ORDER BY turn, speaker, body) AS n FROM said),
        speakers AS (SELECT DISTINCT conv_id, speaker AS assistant FROM said WHERE speaker <> 'system'),
        seen AS (
          SELECT r.conv_id, part, (n - 1) // 1024 AS piece, n, assistant, speaker = assistant AS own, body || '<|im_end|>' AS tail,
            CASE WHEN speaker = assistant THEN '<|im_start|>assistant' WHEN speaker = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || regexp_replace(speaker, '[ \t\n\x0B\f\r<>|]', '_', 'g') END || chr(10) AS head
          FROM numbered r JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM r.conv_id),
        placed AS (
          SELECT *, CAST(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, assistant ORDER BY part, n) AS BIGINT) - length(tail) - 1 AS start FROM seen)
        SELECT conv_id, part, piece, assistant, min(start - length(head)) AS "begin", string_agg(head || tail || chr(10), '' ORDER BY n) AS text,
          coalesce(string_agg(start || '-' || (start + length(tail)), ' ' ORDER BY n) FILTER (own), '') AS spans, CAST(count(*) AS INT) AS n_turns,
          CAST(coalesce(sum(length(tail)) FILTER (own), 0) AS BIGINT) AS n_masked
        FROM placed GROUP BY conv_id, part, piece, assistant""",
    "op3_decontamination": rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[b:b + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS b FROM items WHERE len(w) > 0)),
grams AS ({" UNION ALL ".join(_grams(k) for k in range(1, 11))}),
spans AS (SELECT row, i, k, item_id FROM grams JOIN item_windows USING (k, gram)),
hits AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + k)) AS p FROM spans) GROUP BY row),
found AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM spans) GROUP BY row)
SELECT doc_id, CAST(COALESCE(len(w), 0) AS BIGINT) AS n_words, COALESCE(hits.n, 0) AS n_hit, COALESCE(found.n, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN found USING (row)""",
    "op5_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
grams AS ("""+_grams(5)+r"""),
twice AS (SELECT row, i FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row),
pairs AS (SELECT row, word, lead(word) OVER (PARTITION BY row ORDER BY i) AS next FROM words),
per_text AS (SELECT row, sum(length(word)) AS chars, count(*) FILTER (word = next) AS same_next FROM pairs GROUP BY row),
book AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[A-Za-z\x{80}-\x{10FFFF}]')) AS n_letters, len(regexp_extract_all(t, '!')) AS n_marks, COALESCE(same_next, 0) AS n_same_next
  FROM docs LEFT JOIN covered USING (row) LEFT JOIN per_text USING (row)),
bits AS (
  SELECT *, CAST("""+" + ".join(f"CASE WHEN {c} THEN {1 << b} ELSE 0 END" for b, c in enumerate(RULES.values()))+r""" AS BIGINT) AS failed FROM book)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM bits""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id, lower(COALESCE(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule_host, rule_path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, COALESCE(arg_max(action, length(rule_host || rule_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path""",
    "op12_lexical_search": r"""
WITH terms AS (
  SELECT pos, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS pos, doc_id, text FROM documents)),
sizes AS (SELECT pos, doc_id, count(*) AS n FROM terms GROUP BY pos, doc_id),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
cells AS (SELECT pos, term, count(*) AS tf FROM terms GROUP BY pos, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM cells, totals GROUP BY term, big_n),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT item_id, pos, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN cells USING (term) JOIN sizes USING (pos), totals GROUP BY item_id, pos, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
    "op13_hard_negatives": r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
}
