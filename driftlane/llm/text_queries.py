"""Queries of the operators that are DataFrame functions all through, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.chat import chat_texts
from driftlane.llm.common import LOWER, UPPER, table
from driftlane.llm.decontamination import decontaminate
from driftlane.llm.fingerprints import fingerprint_pairs
from driftlane.llm.licenses import scan_licenses
from driftlane.llm.mixing import fair_queue
from driftlane.llm.registry import query

_MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
    CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS k
  FROM documents
), per AS (SELECT k, sum(size)::bigint AS s FROM sizes GROUP BY k),
weighted AS (
  SELECT k, s, 2 * s AS cap, [3, 1, 2][((row_number() OVER (ORDER BY encode(k)) - 1) % 3 + 1)::int] AS w FROM per
), levels AS (
  SELECT *, cap::double / w AS full_at,
    (1.5 * (sum(s) OVER ())::double
      - coalesce(sum(cap) OVER (ORDER BY cap::double / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
      / sum(w) OVER (ORDER BY cap::double / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::double AS level
  FROM weighted
), reached AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE level <= full_at),
targets AS (
  SELECT k, s, CASE WHEN r.level IS NULL THEN cap::double ELSE least(cap::double, r.level * w) END AS target
  FROM levels l, reached r
), placed AS (
  SELECT doc_id, k, size,
    (sum(size) OVER (PARTITION BY k ORDER BY md5(coalesce(doc_id::varchar, '') || ':' || size), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::bigint - size AS start
  FROM sizes
)
SELECT doc_id, size, s AS source_size, target,
  (greatest(0, least(size, floor(target)::bigint - start)) + greatest(0, least(size, floor(target)::bigint - s - start)))::bigint AS taken
FROM placed JOIN targets USING (k)
"""

_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::varchar, '') AS item, {_WORDS} AS w, least(10, len({_WORDS})) AS need FROM benchmark),
iw AS (
  SELECT DISTINCT item, need, array_to_string(w[s:s + need - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, (len(w) - need + 2)::bigint)) AS s FROM i WHERE need > 0)
), needs AS (SELECT DISTINCT need FROM iw),
dw AS (
  SELECT doc_id, need, s, array_to_string(w[s:s + need - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, (len(w) - need + 2)::bigint)) AS s FROM d, needs WHERE len(w) >= need)
), met AS (SELECT doc_id, item, s, dw.need FROM dw JOIN iw USING (need, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + need)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM met GROUP BY doc_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CHAT_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations
), c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY n) AS turns, count(*) AS n_turns FROM t GROUP BY conv_id
), proper AS (
  SELECT DISTINCT i AS n_turns, turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS i FROM c)
), whole AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.n_turns = w.n_turns AND p.turns = w.turns))
SELECT t.conv_id, n // 1024 AS part, n_turns, n_copies,
  string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS text
FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id, n // 1024, n_turns, n_copies
"""


@query("op4_weighted_fair_mix", _MIX_SQL)
def op4_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue(table(spark, sf_dir, "documents")).drop("slots")


@query("op7_chat_snapshots", _CHAT_SQL)
def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_texts(table(spark, sf_dir, "conversations"))


@query("op8_positional_index", _LEAK_SQL)
def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op9_imatch")
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


@query("op10_license_rules")
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_detections", F.size("detections").cast("bigint")).drop("detections")
