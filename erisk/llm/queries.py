"""The registered queries of this subpackage: each applies one operator to the whole of its given table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from erisk.llm import attribution, audit, classifier, decontamination, html, jaccard, language, packing, peeling, rules, sharding, simhash, warc
from erisk.llm.common import prepare, table
from erisk.session import shared_folder


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html.extracted(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return attribution.attributed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "llm-warc"))
    return warc.read_archives(archives).drop("url", "archive", "error")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "longest")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.identified(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return peeling.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.deduplicated(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}

#: Twins in DuckDB's SQL, where SQL can express the operator.
ORACLE: dict[str, str] = {"op8_decontamination": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, least(1, len(w))) + 1)) AS i FROM b)),
p AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
o AS (SELECT rid, i, n, q.item_id FROM p JOIN q USING (n, g)),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM o) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM o GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""}


def tree_rows(tree: list[sharding.Shard], name: str) -> str:
    return f"{name}(region, rack, shard, weight) AS (VALUES " + ", ".join(
        f"('{s.region}', '{s.rack}', {s.shard}, {s.weight})" for s in tree) + ")"


def descent(tree: str, out: str) -> str:
    """One level after the other: the child with the least draw, among the children of the node chosen before."""
    drawn = "-ln((('0x' || substr(md5({0} || '|' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {1}"
    return f"""
{out}1 AS (SELECT rid, key, arg_min(region, {drawn.format('region', 'w')}) AS region
  FROM d, (SELECT region, sum(weight) AS w FROM {tree} GROUP BY region) GROUP BY rid, key),
{out}2 AS (SELECT rid, key, region, arg_min(rack, {drawn.format("region || '/' || rack", 'w')}) AS rack
  FROM {out}1 JOIN (SELECT region, rack, sum(weight) AS w FROM {tree} GROUP BY region, rack) USING (region) GROUP BY rid, key, region),
{out} AS (SELECT rid, arg_min(shard, {drawn.format("region || '/' || rack || '/' || shard", 'weight')}) AS shard
  FROM {out}2 JOIN {tree} USING (region, rack) GROUP BY rid)"""


ORACLE["op5_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""

ORACLE["op7_sharding"] = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc),
{tree_rows(sharding.TREE, 'tree')}, {tree_rows(sharding.GROWN, 'grown')},
{descent('tree', 'a')}, {descent('grown', 'b')}
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, b.shard AS grown_shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY
           ('0x' || substr(md5('slot|' || key || '|' || text_crc32 || '|' || size), 1, 13))::BIGINT, doc_id, text_crc32, size) - 1 AS slot
FROM d JOIN a USING (rid) JOIN b USING (rid)
"""

ORACLE["op11_filter_audit"] = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN m USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS early FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails = own AS alone, contains(fails, own) AS here,
         length(early) > 0 AND regexp_matches(fails, '[' || CASE early WHEN '' THEN '-' ELSE early END || ']') AS gone
  FROM cells, s),
g AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM g
"""

ORACLE["op12_prefix_trie"] = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
own AS (
  SELECT c.conv_id, 0 AS side, p, k, size FROM c JOIN turns ON turns.conv_id = base WHERE p <= h
  UNION ALL SELECT c.conv_id, 1, p, k, size FROM c JOIN turns USING (conv_id) WHERE p > h),
placed AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY side, p) AS d FROM own),
pre AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM c
  UNION ALL SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d), size FROM placed),
len AS (SELECT conv_id, max(depth) AS n FROM pre GROUP BY conv_id),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM pre JOIN len USING (conv_id) GROUP BY path, depth),
kids AS (SELECT path[:-33] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
below AS (
  SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM full_ a JOIN full_ b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (path) LEFT JOIN node up ON f.depth > 0 AND up.path = f.path[:-33]
"""
