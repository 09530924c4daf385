"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import conversation_trie, decontamination, filter_audit, fingerprints, language, licenses, lm_scoring, mixing, near_duplicates, packing, pii, sharding, toxicity
from blockweave.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("detections")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify_language(docs, language.learnable(docs))


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(documents(spark, sf_dir), decontamination.benchmark_table(spark, sf_dir))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stated key, so that runs can be compared, unless the session sets its own
    out = pii.pseudonymise_documents(documents(spark, sf_dir), spark.conf.get(pii.KEY_SETTING, "op7_feistel_pseudonyms"))
    return out.select("doc_id", "text", "n_values", F.array_join(F.array_sort(F.array_distinct(F.col("spans.kind"))), ",").alias("kinds"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lm_scoring.score_documents(documents(spark, sf_dir), lm_scoring.good_documents(labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, language.learnable(docs), labels).select("doc_id", "held_out", "score", "predicted", F.array_join("found", ",").alias("found"))


def op10_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir), k=3, percent=85)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_language_id, op3_latent_decontamination, op4_sum_of_squares_packing, op5_merkle_fingerprints, op6_byte_shards, op7_feistel_pseudonyms, op8_cross_entropy_difference, op9_toxicity, op10_chosen_path_near_duplicates, op11_conversation_prefix_trie, op12_mix_sources, op13_filter_interactions, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express; the others have brute-force tests."""
    return {"op5_merkle_fingerprints": OP5_SQL, "op10_chosen_path_near_duplicates": OP10_SQL, "op11_conversation_prefix_trie": OP11_SQL, "op13_filter_interactions": OP13_SQL}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC, text DESC), first_value(text) OVER (ORDER BY doc_id DESC, text DESC)) AS nxt
  FROM d
),
e AS (SELECT *, left(text, n - n // 2) || left(nxt, n // 2) AS edited FROM n),
l AS (
  SELECT doc_id, n, edited,
    list_transform(string_split(text, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,80}?(?:[dgklmrw] |\z)|[^\n]{1,80}'), lambda x: sha256(x))) AS own,
    list_transform(string_split(edited, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,80}?(?:[dgklmrw] |\z)|[^\n]{1,80}'), lambda x: sha256(x))) AS other,
    list_transform(string_split(nxt, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^\n]{1,80}?(?:[dgklmrw] |\z)|[^\n]{1,80}'), lambda x: sha256(x))) AS nx
  FROM e
),
s AS (
  SELECT doc_id, n, edited, list_distinct(flatten(own)) AS a, list_distinct(flatten(other)) AS b, list_distinct(flatten(nx)) AS c,
    list_transform(string_split(regexp_replace(array_to_string(list_transform(own, lambda p: sha256(array_to_string(p, ''))), ';') || ';', '([0-3]);', '\1;|', 'g'), '|'), lambda x: sha256(x)) AS mine,
    list_transform(string_split(regexp_replace(array_to_string(list_transform(other, lambda p: sha256(array_to_string(p, ''))), ';') || ';', '([0-3]);', '\1;|', 'g'), '|'), lambda x: sha256(x)) AS theirs
  FROM l
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(mine, '')) AS fingerprint, sha256(array_to_string(theirs, '')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 9) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)), 9) END AS near_next,
  len(mine)::BIGINT AS n_sections, len(list_filter(list_distinct(mine), lambda x: NOT list_contains(theirs, x)))::BIGINT AS n_differing
FROM s
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""

#: crc32 is taken bit by bit; a node is named by the digests of its turns, one after another.
OP11_SQL = r"""
WITH o AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
),
i AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
      flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: list_transform(range(8), lambda b: (ascii(substr(CAST(conv_id AS VARCHAR), k, 1)) >> b) & 1))),
      lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM o WHERE d = 1
),
g AS (SELECT i.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = i.base)) AS given FROM i),
r AS (
  SELECT g.conv_id, o.d, o.x, o.w FROM g JOIN o ON o.conv_id = g.base AND o.d <= g.h
  UNION ALL SELECT g.conv_id, o.d - g.h + g.given, o.x, o.w FROM g JOIN o ON o.conv_id = g.conv_id AND o.d > g.h
),
p AS (SELECT conv_id, d, w, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM g),
e AS (SELECT conv_id, max(d) AS d FROM p GROUP BY 1),
n AS (SELECT node, any_value(d) AS d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN e ON e.conv_id = p.conv_id AND e.d = p.d GROUP BY 1),
s AS (
  SELECT up.node, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved
  FROM n LEFT JOIN k ON k.node = n.node, LATERAL (SELECT left(n.node, CAST(32 * y AS BIGINT)) AS node FROM (SELECT unnest(range(n.d + 1)) AS y) z) up GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS INT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN f ON f.node = n.node LEFT JOIN n up ON n.d > 0 AND up.node = left(n.node, length(n.node) - 32)
"""

OP13_SQL = r"""
WITH RECURSIVE o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
s AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, CAST(k AS INT), 1)) - 1))), 0)::BIGINT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
),
a AS (SELECT c.*, s.*, c.mask & s.own <> 0 AS fails, c.mask & s.before <> 0 AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(1, bit_count(mask::INT))) FILTER (WHERE fails), 0)::BIGINT AS shapley
FROM a GROUP BY 1, 2, 3
"""
