"""Scores, audits and distributions over cases, replies and runs."""

from __future__ import annotations

from finspark.plans.shared import Catalog

C = Catalog()
_N = "SUM(CASE WHEN result = 'TP' THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN result = 'FP' THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN result = 'FN' THEN 1 ELSE 0 END) AS fn"
_N = _N.replace("SUM(CASE", "COUNT(CASE").replace("ELSE 0 END)", "END)")


def _rates(inner: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn,
      CAST(ROUND(CAST(tp AS DOUBLE) / GREATEST(tp + fp, 1), 4) AS DECIMAL(9,4)) AS p, CAST(ROUND(CAST(tp AS DOUBLE) / GREATEST(tp + fn, 1), 4) AS DECIMAL(9,4)) AS r,
      CAST(ROUND(2.0 * CAST(tp AS DOUBLE) / GREATEST(2 * tp + fp + fn, 1), 4) AS DECIMAL(9,4)) AS f1 FROM ({inner}) t"""


C.add("prf_conventions", _rates(f"SELECT error_type, {_N} FROM {{case_evidence}} GROUP BY error_type", "error_type"))
C.add("per_type_recall", "SELECT error_type, COUNT(CASE WHEN result = 'TP' THEN 1 END) AS hit, COUNT(*) AS golds FROM {case_evidence} WHERE result <> 'FP' GROUP BY error_type")
C.add("arm_scores", _rates(f"SELECT arm, {_N} FROM {{case_evidence}} GROUP BY arm", "arm"))
C.add("strata_grouping_sets", f"SELECT arm, error_type, cohort, {_N} FROM {{case_evidence}} GROUP BY GROUPING SETS ((arm), (error_type), (cohort), ())")
C.add("arm_delta", """WITH a AS (SELECT document_id, COUNT(CASE WHEN result = 'TP' THEN 1 END) AS tp, COUNT(CASE WHEN result = 'FP' THEN 1 END) AS fp, COUNT(CASE WHEN result = 'FN' THEN 1 END) AS fn, arm FROM {case_evidence} GROUP BY document_id, arm)
  SELECT COALESCE(x.document_id, y.document_id) AS document_id, COALESCE(y.tp, 0) - COALESCE(x.tp, 0) AS d_tp, COALESCE(y.fp, 0) - COALESCE(x.fp, 0) AS d_fp, COALESCE(y.fn, 0) - COALESCE(x.fn, 0) AS d_fn
  FROM (SELECT * FROM a WHERE arm = (SELECT MIN(arm) FROM {case_evidence})) x FULL OUTER JOIN (SELECT * FROM a WHERE arm = (SELECT MAX(arm) FROM {case_evidence})) y ON x.document_id = y.document_id""")  # fmt: skip
C.add("binary_detection", """WITH d AS (SELECT i.document_id, MAX(CASE WHEN c.result IN ('TP', 'FN') THEN 1 ELSE 0 END) AS truth, MAX(CASE WHEN c.result IN ('TP', 'FP') THEN 1 ELSE 0 END) AS said
    FROM (SELECT DISTINCT document_id FROM {inputs_research442}) i LEFT JOIN {case_evidence} c ON i.document_id = c.document_id GROUP BY i.document_id)
  SELECT COUNT(CASE WHEN truth = 1 AND said = 1 THEN 1 END) AS tp, COUNT(CASE WHEN truth = 0 AND said = 1 THEN 1 END) AS fp, COUNT(CASE WHEN truth = 1 AND said = 0 THEN 1 END) AS fn, COUNT(CASE WHEN truth = 0 AND said = 0 THEN 1 END) AS tn FROM d""")  # fmt: skip
C.add("macro_f1_arms", """SELECT arm, CAST(ROUND(AVG(f), 4) AS DECIMAL(9,4)) AS macro_f1 FROM (SELECT arm, error_type, 2.0 * COUNT(CASE WHEN result = 'TP' THEN 1 END) / GREATEST(2 * COUNT(CASE WHEN result = 'TP' THEN 1 END) + COUNT(CASE WHEN result <> 'TP' THEN 1 END), 1) AS f
  FROM {case_evidence} GROUP BY arm, error_type) t GROUP BY arm""".replace("2.0 * COUNT", "CAST(2 AS DOUBLE) * COUNT"))  # fmt: skip
C.add("missing_predictions", "SELECT i.document_id FROM (SELECT DISTINCT document_id FROM {inputs_research442} WHERE document_id IS NOT NULL) i LEFT JOIN (SELECT DISTINCT document_id FROM {case_evidence}) c ON i.document_id = c.document_id WHERE c.document_id IS NULL")
C.add("outer_doc_pairing", """SELECT COALESCE(a.document_id, b.document_id) AS document_id, COALESCE(a.cases, 0) AS cases, COALESCE(b.replies, 0) AS replies FROM (SELECT document_id, COUNT(*) AS cases FROM {case_evidence} WHERE document_id IS NOT NULL GROUP BY document_id) a
  FULL OUTER JOIN (SELECT document_id, COUNT(*) AS replies FROM {model_responses} WHERE document_id IS NOT NULL GROUP BY document_id) b ON a.document_id = b.document_id""")  # fmt: skip
C.add("latency_quantiles", """SELECT purpose, n, CAST(ROUND(med, 4) AS DECIMAL(18,4)) AS median_s, CAST(ROUND(p95, 4) AS DECIMAL(18,4)) AS p95_s FROM (SELECT purpose, COUNT(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY trace.duration_seconds) AS med, percentile_disc(0.95) WITHIN GROUP (ORDER BY trace.duration_seconds) AS p95
  FROM {model_responses} WHERE trace.duration_seconds IS NOT NULL GROUP BY purpose) t""")  # fmt: skip
C.add("usage_by_call", """SELECT source, COUNT(*) AS calls, CAST(SUM(CAST(inp AS BIGINT)) AS BIGINT) AS input_tokens, CAST(SUM(CAST(outp AS BIGINT)) AS BIGINT) AS output_tokens, COUNT(CASE WHEN inp IS NULL THEN 1 END) AS unknown_usage FROM (SELECT source, trace.input_tokens AS inp, trace.output_tokens AS outp,
  row_number() OVER (PARTITION BY messages_sha256 ORDER BY trace.attempt, response_key) AS rn FROM {model_responses}) t WHERE rn = 1 GROUP BY source""")  # fmt: skip
C.add("usage_distribution", "SELECT source, COUNT(*) AS runs, CAST(SUM(CAST(usage.model_calls AS BIGINT)) AS BIGINT) AS model_calls, CAST(SUM(CAST(usage.tool_calls AS BIGINT)) AS BIGINT) AS tool_calls, MAX(usage.model_calls) AS most_calls FROM {run_results} GROUP BY source")
C.add("run_completeness", "SELECT source, status, stop_reason, COUNT(*) AS runs, COUNT(CASE WHEN last_message IS NULL OR TRIM(last_message) = '' THEN 1 END) AS without_message FROM {run_results} GROUP BY source, status, stop_reason")
C.add("review_dismissal", """SELECT error_type, COUNT(CASE WHEN review.status IS NOT NULL THEN 1 END) AS decided, COUNT(CASE WHEN review.status = 'dismissed' THEN 1 END) AS dismissed, COUNT(*) AS cases FROM {case_evidence} GROUP BY GROUPING SETS ((error_type), ())""")
C.add("review_by_analyst", "SELECT review.analyst AS analyst, review.status AS status, COUNT(*) AS cases FROM {case_evidence} WHERE review IS NOT NULL GROUP BY review.analyst, review.status")
C.add("review_timing", "SELECT review.analyst AS analyst, COUNT(*) AS timed, CAST(MIN(review.reviewed_at) AS DATE) AS first_day, CAST(MAX(review.reviewed_at) AS DATE) AS last_day FROM {case_evidence} WHERE review.reviewed_at IS NOT NULL GROUP BY review.analyst")
C.add("hhi_concentration", """SELECT CAST(ROUND(SUM(s * s), 6) AS DECIMAL(12,6)) AS hhi, CAST(ROUND(MAX(s), 6) AS DECIMAL(12,6)) AS largest FROM (SELECT CAST(COUNT(*) AS DOUBLE) / CAST((SELECT COUNT(*) FROM {facts}) AS DOUBLE) AS s FROM {facts} GROUP BY company) t""")
C.add("total_variation", """WITH a AS (SELECT error_type, CAST(COUNT(*) AS DOUBLE) / CAST((SELECT COUNT(*) FROM {case_evidence} WHERE result = 'FP') AS DOUBLE) AS s FROM {case_evidence} WHERE result = 'FP' GROUP BY error_type),
  b AS (SELECT error_type, CAST(COUNT(*) AS DOUBLE) / CAST((SELECT COUNT(*) FROM {case_evidence} WHERE result = 'FN') AS DOUBLE) AS s FROM {case_evidence} WHERE result = 'FN' GROUP BY error_type)
  SELECT CAST(ROUND(SUM(ABS(COALESCE(a.s, 0) - COALESCE(b.s, 0))) / 2, 6) AS DECIMAL(12,6)) AS distance FROM a FULL OUTER JOIN b ON a.error_type = b.error_type""")  # fmt: skip
C.add("annotation_health", """SELECT error_type, COUNT(*) AS errors, COUNT(CASE WHEN gold.scorable THEN 1 END) AS scorable, COUNT(CASE WHEN prediction.invalid_anchor THEN 1 END) AS invalid_anchors FROM {case_evidence} GROUP BY error_type""")
C.add("rule_gain", "SELECT root_cause, arm, COUNT(CASE WHEN result = 'TP' THEN 1 END) AS gained, COUNT(CASE WHEN result = 'FP' THEN 1 END) AS cost FROM {case_evidence} GROUP BY root_cause, arm")
C.add("review_burden", "SELECT error_type, prediction.validation AS validation, COUNT(*) AS n FROM {case_evidence} WHERE prediction IS NOT NULL GROUP BY error_type, prediction.validation")
C.add("focus_miss_buckets", """WITH p AS (SELECT document_id, error_type FROM {case_evidence} WHERE result = 'FP'), g AS (SELECT case_id, document_id, error_type FROM {case_evidence} WHERE result = 'FN')
  SELECT bucket, COUNT(*) AS misses FROM (SELECT g.case_id, MAX(CASE WHEN p.error_type = g.error_type THEN 2 WHEN p.document_id IS NOT NULL THEN 1 ELSE 0 END) AS bucket FROM g LEFT JOIN p ON p.document_id = g.document_id GROUP BY g.case_id) t GROUP BY bucket""")  # fmt: skip
C.add("confusion_types", "SELECT gold.error_type AS gold_type, prediction.error_type AS predicted_type, COUNT(*) AS n FROM {case_evidence} WHERE gold IS NOT NULL AND prediction IS NOT NULL GROUP BY gold.error_type, prediction.error_type")
C.add("budget_running_total", """SELECT request_id, running, CASE WHEN running <= 50000000 THEN 'granted' ELSE 'over_cap' END AS decision FROM (SELECT request_id, source, CAST(SUM(micro) OVER (PARTITION BY source ORDER BY finished_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
  FROM (SELECT request_id, source, finished_at, CAST(CEIL(CAST(usage.cost_cny AS DECIMAL(18,8)) * 1000000) AS BIGINT) AS micro FROM {run_results} WHERE usage.cost_cny IS NOT NULL) t) u""")  # fmt: skip
C.add("complete_case_docs", "SELECT document_id FROM {case_evidence} WHERE document_id IS NOT NULL GROUP BY document_id HAVING COUNT(DISTINCT arm) = (SELECT COUNT(DISTINCT arm) FROM {case_evidence})")
C.add("response_reuse", "SELECT messages_sha256, COUNT(*) AS replies, MIN(response_key) AS kept FROM {model_responses} WHERE content IS NOT NULL AND trace.finish_reason = 'stop' GROUP BY messages_sha256")
C.add("balanced_accuracy_ops", """SELECT purpose, CAST(ROUND(AVG(r), 4) AS DECIMAL(9,4)) AS bacc FROM (SELECT purpose, trace.finish_reason AS actual, CAST(COUNT(CASE WHEN content IS NOT NULL AND length(content) > 100 THEN 1 END) AS DOUBLE) / COUNT(*) AS r FROM {model_responses} WHERE trace.finish_reason IS NOT NULL GROUP BY purpose, trace.finish_reason) t GROUP BY purpose""")
C.add("selection_regret", """WITH m AS (SELECT source, purpose, CAST(COUNT(CASE WHEN trace.finish_reason = 'stop' THEN 1 END) AS DOUBLE) / COUNT(*) AS s FROM {model_responses} WHERE source IS NOT NULL GROUP BY source, purpose),
  o AS (SELECT source, AVG(s) AS a FROM m GROUP BY source), k AS (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY ROUND(a, 9) DESC, source) AS rn FROM o) t WHERE rn <= 2)
  SELECT m.purpose, CAST(ROUND(MAX(m.s) - MAX(CASE WHEN k.source IS NOT NULL THEN m.s END), 4) AS DECIMAL(9,4)) AS regret FROM m LEFT JOIN k ON m.source = k.source GROUP BY m.purpose""")  # fmt: skip
C.add("paired_acceptance", """SELECT cohort, COUNT(*) AS cases, COUNT(CASE WHEN review.status = 'accepted' OR review.status = 'confirmed' THEN 1 END) AS accepted, COUNT(CASE WHEN review.status IS NULL THEN 1 END) AS open_cases FROM {case_evidence} GROUP BY cohort""")
C.add("fp_inversion", """SELECT error_type, golds, CAST(ROUND(rec * golds, 0) AS BIGINT) AS tp, CASE WHEN prec > 0 THEN CAST(ROUND(ROUND(rec * golds, 0) * (1 - prec) / prec, 0) AS BIGINT) END AS fp FROM (SELECT error_type, COUNT(CASE WHEN result <> 'FP' THEN 1 END) AS golds,
  CAST(COUNT(CASE WHEN result = 'TP' THEN 1 END) AS DOUBLE) / GREATEST(COUNT(CASE WHEN result <> 'FP' THEN 1 END), 1) AS rec, CAST(COUNT(CASE WHEN result = 'TP' THEN 1 END) AS DOUBLE) / GREATEST(COUNT(CASE WHEN result <> 'FN' THEN 1 END), 1) AS prec FROM {case_evidence} GROUP BY error_type) t""")  # fmt: skip
QUERIES, SQL = C.queries, C.sql
