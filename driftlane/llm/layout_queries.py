"""Queries of the operators that lay a corpus out: shards, prefix trie and manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.common import LOWER, UPPER, table
from driftlane.llm.merkle import manifest
from driftlane.llm.prefix_trie import prefix_trie
from driftlane.llm.registry import query
from driftlane.llm.sharding import shard_documents


def _crc32_sql(number: str) -> str:
    """The unsigned crc32 of a number's decimal text: a step per byte and one per bit."""
    codes = f"list_transform(string_split({number}::varchar, ''), lambda c: ord(c)::bigint)"
    steps = f"flatten(list_transform({codes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295], {steps}), lambda c, s: "
        "CASE WHEN s >= 0 THEN xor(c, s) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )


_TRIE_SQL = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
  ) AS n FROM conversations
), convs AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, ({_crc32_sql('conv_id')}) % 9 AS h, count(*) AS own FROM o GROUP BY conv_id),
members AS (
  SELECT c.*, least(h, coalesce((SELECT count(*) FROM o WHERE o.conv_id = c.donor), 0)) AS taken FROM convs c
), turns AS (
  SELECT m.conv_id, o.n AS depth, o.role, o.text FROM members m JOIN o ON o.conv_id = m.donor WHERE o.n <= m.h
  UNION ALL
  SELECT m.conv_id, o.n - m.h + m.taken, o.role, o.text FROM members m JOIN o USING (conv_id) WHERE o.n > m.h
), whole AS (
  SELECT m.conv_id, coalesce(list([role, text] ORDER BY depth) FILTER (depth IS NOT NULL), []) AS seq
  FROM members m LEFT JOIN turns t USING (conv_id) GROUP BY m.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, seq[1:d] AS node, len(seq) AS length FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), family AS (
  SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.node[1:c.depth - 1]
), counted AS (
  SELECT f.*, (SELECT count(*) FROM nodes k WHERE k.depth = f.depth + 1 AND k.node[1:f.depth] = f.node) AS n_children FROM family f
), above AS (
  SELECT node[1:a] AS top, a AS top_depth, n_children = 0 AS leaf,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[depth][2]) END AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM counted)
), sums AS (
  SELECT top_depth, top, sum(leaf::bigint)::bigint AS n_leaves, sum(saved)::bigint AS saved_tokens FROM above GROUP BY top_depth, top
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums ON top_depth = depth AND top = node
"""


def _manifest_sql(in_source: int = 5, over_sources: int = 4) -> str:
    """The levels unrolled: enough for 16 ** 5 documents of a source and 16 ** 4 sources. A level of one node changes nothing."""
    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::varchar) || ':' || {value}::varchar END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    steps = [f"""
WITH l AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN ({_crc32_sql('doc_id')}) % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS shown
  FROM documents
), d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n0 AS (SELECT source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM d),
p0 AS (SELECT doc_id, source, pos, pos AS place, leaf, shown AS folded, '' AS proof FROM d)"""]

    def level(number: int, tree: str) -> str:
        """One level of all trees of ``tree``; every document folds its digest and adds its siblings."""
        a, b = number, number + 1
        run = f"t.{tree} IS NOT DISTINCT FROM p.{tree}" if tree == "source" else "true"
        keys = f"{tree}, " if tree == "source" else ""
        return f"""
r{a} AS (SELECT {keys}pos // 16 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS digests FROM n{a} GROUP BY {keys}pos // 16),
n{b} AS (
  SELECT {keys}run AS pos, CASE WHEN n > 1 THEN sha256(list_aggregate(digests, 'string_agg', '')) ELSE digests[1] END AS digest,
    ((n + 15) // 16)::bigint AS n FROM r{a}
),
p{b} AS (
  SELECT p.* EXCLUDE (place, folded, proof), place // 16 AS place,
    CASE WHEN n > 1 THEN sha256(coalesce(list_aggregate(digests[1:place % 16], 'string_agg', ''), '') || folded
      || coalesce(list_aggregate(digests[place % 16 + 2:], 'string_agg', ''), '')) ELSE folded END AS folded,
    CASE WHEN n > 1 THEN proof || coalesce(list_aggregate(digests[1:place % 16], 'string_agg', ''), '')
      || coalesce(list_aggregate(digests[place % 16 + 2:], 'string_agg', ''), '') ELSE proof END AS proof
  FROM p{a} p JOIN r{a} t ON {run} AND t.run = p.place // 16
)"""

    steps += [level(i, "source") for i in range(in_source)]
    s, t = in_source, in_source + 1
    steps.append(f"""
n{t} AS (SELECT row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, digest, source, count(*) OVER () AS n FROM n{s}),
p{t} AS (SELECT p.* EXCLUDE (place), m.pos AS place, m.digest AS subroot FROM p{s} p JOIN n{t} m ON m.source IS NOT DISTINCT FROM p.source)""")
    steps += [level(t + i, "all") for i in range(over_sources)]
    end = t + over_sources
    steps.append("")
    return ",".join(steps)[:-1] + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM p{end}, n{end} r"""


@query("op11_vector_shards")
def op11_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


@query("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


@query("op13_merkle_manifest", _manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )
