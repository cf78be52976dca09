"""Duplicates, groups that must not be separated, splits, queues and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.operators import graph
from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()
C.add("exact_duplicate_groups", "SELECT content_sha256, COUNT(*) AS copies, COUNT(DISTINCT document_id) AS documents, MIN(document_id) AS kept FROM {inputs_research442} WHERE content IS NOT NULL GROUP BY content_sha256 HAVING COUNT(*) > 1")
C.add("normalized_duplicates", "SELECT normalized_content_sha256 AS sha, COUNT(DISTINCT content_sha256) AS forms, COUNT(*) AS copies FROM {inputs_research442} GROUP BY normalized_content_sha256 HAVING COUNT(DISTINCT content_sha256) > 1")
C.add("document_duplicates", "SELECT sha2(text, 256) AS h, COUNT(*) AS copies, MIN(doc_id) AS kept FROM {documents} WHERE text IS NOT NULL GROUP BY sha2(text, 256) HAVING COUNT(*) > 1", "SELECT sha256(text) AS h, COUNT(*) AS copies, MIN(doc_id) AS kept FROM {documents} WHERE text IS NOT NULL GROUP BY sha256(text) HAVING COUNT(*) > 1")
C.add("group_crossing_audit", "SELECT group_id, COUNT(DISTINCT split) AS splits, COUNT(*) AS n FROM {inputs_research442} WHERE group_id IS NOT NULL GROUP BY group_id HAVING COUNT(DISTINCT split) > 1")
C.add("group_keys", "SELECT document_id, k, COUNT(*) AS n FROM (SELECT document_id, explode(group_keys) AS k FROM {inputs_research442}) t GROUP BY document_id, k", "SELECT document_id, k, COUNT(*) AS n FROM (SELECT document_id, unnest(group_keys) AS k FROM {inputs_research442}) t GROUP BY document_id, k")
C.frame(
    "connected_components",
    lambda spark, d: graph.components(table(spark, d, "inputs_research442").select("document_id", F.explode("group_keys").alias("key")), "document_id", "key"),
    """WITH RECURSIVE e AS (SELECT DISTINCT document_id AS i, unnest(group_keys) AS k FROM inputs_research442 WHERE document_id IS NOT NULL), e2 AS (SELECT * FROM e WHERE k IS NOT NULL),
    p AS (SELECT DISTINCT a.i AS a, b.i AS b FROM e2 a JOIN e2 b ON a.k = b.k), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS document_id, MIN(b) AS component FROM r GROUP BY a""",
)
C.add("hash_role_split", """SELECT group_id, CASE WHEN rn <= CEIL(0.3 * n) THEN 'validation' ELSE 'development' END AS role FROM (SELECT group_id, row_number() OVER (ORDER BY sha2('7|' || group_id, 256)) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM {inputs_research442} WHERE group_id IS NOT NULL) g) t""",
      """SELECT group_id, CASE WHEN rn <= CEIL(0.3 * n) THEN 'validation' ELSE 'development' END AS role FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('7|' || group_id)) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM {inputs_research442} WHERE group_id IS NOT NULL) g) t""")  # fmt: skip
_MOD = "SELECT document_id, CASE WHEN r = 0 THEN 'dev' ELSE 'train' END AS split FROM (SELECT document_id, {f} AS r FROM (SELECT DISTINCT document_id FROM {{inputs_research442}} WHERE document_id IS NOT NULL) x) t"
C.add("mod_hash_split", _MOD.format(f="aggregate(transform(split(sha1(document_id), ''), c -> instr('0123456789abcdef', c) - 1), CAST(0 AS INT), (a, v) -> CAST((a * 16 + v) % 5 AS INT))"),
      _MOD.format(f="list_reduce([CAST(0 AS BIGINT)] || list_transform(string_split(sha1(document_id), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, v: (a * 16 + v) % 5)"))
C.add("round_robin_queue", "SELECT document_id, row_number() OVER (ORDER BY rn, stratum, document_id) AS place FROM (SELECT document_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY document_id) AS rn FROM (SELECT DISTINCT document_id, COALESCE(scene, '') || '/' || COALESCE(length_bucket, '') AS stratum FROM {inputs_research442} WHERE document_id IS NOT NULL) x) t")
C.add("stable_hash_sample", "SELECT error_type, result, case_id FROM (SELECT error_type, result, case_id, row_number() OVER (PARTITION BY error_type, result ORDER BY sha2(case_id, 256)) AS rn FROM {case_evidence}) t WHERE rn <= 2", "SELECT error_type, result, case_id FROM (SELECT error_type, result, case_id, row_number() OVER (PARTITION BY error_type, result ORDER BY sha256(case_id)) AS rn FROM {case_evidence}) t WHERE rn <= 2")
C.add("occurrence_ids", "SELECT case_id, row_number() OVER (PARTITION BY document_id, error_type ORDER BY case_id) AS occurrence FROM {case_evidence}")
C.add("capped_checks", "SELECT document_id, case_id FROM (SELECT document_id, case_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, case_id) AS rn FROM {case_evidence}) t WHERE rn <= 6")
C.add("review_queue", "SELECT case_id, error_type, CASE WHEN result = 'FP' THEN 'high' ELSE 'low' END AS priority FROM {case_evidence} WHERE review.status IS NULL")
C.add("fewshot_candidates", "SELECT document_id FROM (SELECT document_id, row_number() OVER (ORDER BY length_chars, document_id) AS rn FROM (SELECT DISTINCT document_id, length_chars FROM {inputs_research442} WHERE split = 'train' AND length_chars > 100) t) u WHERE rn <= 3")
C.add("ambiguous_labels", "SELECT document_id, COUNT(DISTINCT error_type) AS labels FROM {case_evidence} WHERE document_id IS NOT NULL GROUP BY document_id HAVING COUNT(DISTINCT error_type) > 1")
C.add("claim_pairs", "SELECT a.row_id AS before_row, b.row_id AS after_row FROM {facts} a JOIN {facts} b ON a.company = b.company AND a.metric = b.metric AND a.period = b.period AND a.scope = b.scope AND a.currency = b.currency WHERE a.basis = 'before' AND b.basis = 'after' AND a.company <> 'unknown' AND TRIM(a.company) <> ''")
C.add("group_role_audit", "SELECT k, COUNT(DISTINCT split) AS roles, COUNT(DISTINCT document_id) AS documents FROM (SELECT document_id, split, explode(group_keys) AS k FROM {inputs_research442}) t GROUP BY k HAVING COUNT(DISTINCT split) > 1", "SELECT k, COUNT(DISTINCT split) AS roles, COUNT(DISTINCT document_id) AS documents FROM (SELECT document_id, split, unnest(group_keys) AS k FROM {inputs_research442}) t GROUP BY k HAVING COUNT(DISTINCT split) > 1")
C.add("subset_signature_dedup", "SELECT lang, sig, COUNT(*) AS copies, MIN(doc_id) AS kept FROM (SELECT doc_id, lang, sha2(COALESCE(title, '') || '|' || COALESCE(company, '') || '|' || CAST(COALESCE(n_chars, -1) AS VARCHAR(20)), 256) AS sig FROM {documents}) t GROUP BY lang, sig HAVING COUNT(*) > 1", "SELECT lang, sig, COUNT(*) AS copies, MIN(doc_id) AS kept FROM (SELECT doc_id, lang, sha256(COALESCE(title, '') || '|' || COALESCE(company, '') || '|' || CAST(COALESCE(n_chars, -1) AS VARCHAR(20))) AS sig FROM {documents}) t GROUP BY lang, sig HAVING COUNT(*) > 1")
C.add("length_buckets", "SELECT split, CASE WHEN length(content) < 300 THEN 'short' WHEN length(content) < 800 THEN 'medium' WHEN length(content) < 2000 THEN 'long' ELSE 'very_long' END AS bucket, COUNT(*) AS n FROM {inputs_research442} WHERE content IS NOT NULL GROUP BY split, CASE WHEN length(content) < 300 THEN 'short' WHEN length(content) < 800 THEN 'medium' WHEN length(content) < 2000 THEN 'long' ELSE 'very_long' END")
C.add("dataset_profile", "SELECT scene, split, source_file, COUNT(*) AS n, COUNT(DISTINCT document_id) AS documents, COUNT(content) AS with_content FROM {inputs_research442} GROUP BY scene, split, source_file")
C.add("review_history", "SELECT document_id, COUNT(*) AS reviews, MAX(review.reviewed_at) AS latest FROM {case_evidence} WHERE review.reviewed_at IS NOT NULL GROUP BY document_id")
C.add("keyed_pair_check", "SELECT 'case_without_document' AS issue, COUNT(*) AS n FROM {case_evidence} c LEFT JOIN (SELECT DISTINCT document_id AS d FROM {inputs_research442}) i ON c.document_id = i.d WHERE i.d IS NULL UNION ALL SELECT 'document_id_null', COUNT(*) FROM {inputs_research442} WHERE document_id IS NULL UNION ALL SELECT 'case_id_repeated', COUNT(*) - COUNT(DISTINCT case_id) FROM {case_evidence}")
C.add("readiness_gate", "SELECT CASE WHEN SUM(n) = 0 THEN 'ready' ELSE 'blocked' END AS status, CAST(SUM(n) AS BIGINT) AS issues FROM (SELECT COUNT(*) AS n FROM {inputs_research442} WHERE content IS NULL UNION ALL SELECT COUNT(*) FROM {inputs_research442} WHERE length(content) <> length_chars UNION ALL SELECT COUNT(*) FROM {case_evidence} WHERE document_id IS NULL) t")
C.add("rule_union", "SELECT case_id, rule FROM (SELECT case_id, 'no_gold' AS rule FROM {case_evidence} WHERE gold IS NULL UNION ALL SELECT case_id, 'no_prediction' FROM {case_evidence} WHERE prediction IS NULL UNION ALL SELECT case_id, 'bad_anchor' FROM {case_evidence} WHERE prediction.invalid_anchor) t")
C.add("edit_set_algebra", "SELECT kind, COUNT(*) AS n FROM (SELECT 'both' AS kind, x FROM (SELECT document_id AS x FROM {case_evidence} WHERE document_id IS NOT NULL INTERSECT SELECT document_id FROM {model_responses} WHERE document_id IS NOT NULL) a UNION ALL SELECT 'cases_only', x FROM (SELECT document_id AS x FROM {case_evidence} WHERE document_id IS NOT NULL EXCEPT SELECT document_id FROM {model_responses} WHERE document_id IS NOT NULL) b) t GROUP BY kind")
C.add("redelivered_facts", "SELECT fact_id, COUNT(*) AS deliveries, MIN(row_id) AS first_row, MAX(row_id) AS last_row FROM {facts} GROUP BY fact_id HAVING COUNT(*) > 1")
QUERIES, SQL = C.queries, C.sql
