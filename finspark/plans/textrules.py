"""Deterministic text detectors and text measures. Detectors emit what they can prove and leave the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()
_CUT = "|"
_SENT = "rx_replace(content, '([。！？!?])', '$1|')"
C.frame(
    "adjacent_duplicate_sentences",
    lambda spark, d: table(spark, d, "inputs_research442")
    .where("content is not null")
    .select("document_id", "source_row", F.posexplode(F.split("content", "[。！？!?\n]+")).alias("i", "s"))
    .withColumn("p", F.lag("s").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("document_id", "source_row").orderBy("i", "s")))
    .where("s = p and length(trim(s)) between 8 and 200")
    .groupBy("document_id")
    .agg(F.countDistinct("s").alias("repeated")),
)
C.add("empty_placeholders", "SELECT document_id, source_row, content_sha256 FROM {inputs_research442} WHERE regexp_like(content, '[(][ ]*[)]|（[ ]*）|“”|《》')")
C.add("suspended_punctuation", "SELECT document_id, source_row, content_sha256 FROM {inputs_research442} WHERE regexp_like(content, '，。|、；|，，|、。')")
C.add("percent_gaps", "SELECT document_id, source_row, content_sha256 FROM {inputs_research442} WHERE regexp_like(content, '(^|[^0-9０-９.．])[%％]')")
C.add("garbled_ratio", "SELECT doc_id, CAST(ROUND(CAST(length(text) - length(replace(text, '�', '')) AS DOUBLE) / GREATEST(length(text), 1), 6) AS DECIMAL(12,6)) AS ratio FROM {documents} WHERE text IS NOT NULL")
_CJK = "length(rx_replace(text, '[^一-鿿]', ''))"
C.add("token_estimate", f"SELECT doc_id, CAST(CEIL({_CJK} * 1.1 + (length(text) - {_CJK}) * 0.275) AS BIGINT) AS tokens FROM {{documents}} WHERE text IS NOT NULL".replace("rx_replace(", "regexp_replace("),
      f"SELECT doc_id, CAST(CEIL({_CJK} * 1.1 + (length(text) - {_CJK}) * 0.275) AS BIGINT) AS tokens FROM {{documents}} WHERE text IS NOT NULL".replace("rx_replace(text, '[^一-鿿]', '')", "regexp_replace(text, '[^一-鿿]', '', 'g')"))
C.add("calendar_dates", "SELECT row_id, period FROM {facts} WHERE regexp_like(period, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(period AS DATE) IS NULL")
C.add("pipe_table_cells", "SELECT doc_id, size(split(line, '[|]')) - 2 AS cells, COUNT(*) AS n FROM (SELECT doc_id, explode(split(text, '[\n]')) AS line FROM {documents} WHERE text IS NOT NULL) t WHERE TRIM(line) LIKE '|%|' GROUP BY doc_id, size(split(line, '[|]')) - 2",
      "SELECT doc_id, CAST(len(string_split(line, '|')) - 2 AS INT) AS cells, COUNT(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents} WHERE text IS NOT NULL) t WHERE TRIM(line) LIKE '|%|' GROUP BY doc_id, len(string_split(line, '|')) - 2")
C.add("context_demotion", "SELECT case_id, CASE WHEN regexp_like(COALESCE(prediction.reason, ''), '更正|例如|并非|不是|应为') THEN 'needs_review' ELSE 'confirmed' END AS status FROM {case_evidence} WHERE prediction IS NOT NULL")
C.add("priority_triage", "SELECT case_id, CASE WHEN prediction.validation = 'verified' THEN 'confirmed' WHEN prediction.invalid_anchor THEN 'low' ELSE 'high' END AS priority FROM {case_evidence} WHERE prediction IS NOT NULL")
C.add("formula_guard", "SELECT row_id, CASE WHEN regexp_like(value, '^[-=+@]') THEN '''' || value ELSE value END AS guarded FROM {facts} WHERE value IS NOT NULL")
C.add("quote_boundary", "SELECT case_id, sp.span_start AS a FROM (SELECT case_id, explode(gold.spans) AS sp FROM {case_evidence} WHERE gold IS NOT NULL) t WHERE regexp_like(sp.text, '[0-9.]$')", "SELECT case_id, sp.span_start AS a FROM (SELECT case_id, unnest(gold.spans) AS sp FROM {case_evidence} WHERE gold IS NOT NULL) t WHERE regexp_matches(sp.text, '[0-9.]$')")
C.add("stock_code_gap", "SELECT doc_id FROM {documents} WHERE regexp_like(text, '[(（][0-9]{{3,5}}[)）]')")
C.add("backward_years", "SELECT doc_id FROM {documents} WHERE TRY_CAST(regexp_extract(text, '(20[0-9][0-9])年至(20[0-9][0-9])年', 1) AS INT) > TRY_CAST(regexp_extract(text, '(20[0-9][0-9])年至(20[0-9][0-9])年', 2) AS INT)")
C.add("line_end_kinds", "SELECT source, COUNT(CASE WHEN position(chr(13) IN text) > 0 THEN 1 END) AS with_cr, COUNT(CASE WHEN position(chr(10) IN text) > 0 THEN 1 END) AS with_lf, COUNT(*) AS n FROM {documents} WHERE text IS NOT NULL GROUP BY source")
C.add("numeric_allowlist", "SELECT response_key, CASE WHEN regexp_like(content, '[0-9]') THEN 'has_numbers' ELSE 'no_numbers' END AS kind FROM {model_responses} WHERE content IS NOT NULL")
C.add("json_fences", "SELECT response_key, CASE WHEN content LIKE '```%```' THEN 'fenced' WHEN content LIKE '```%' THEN 'open_fence' WHEN content LIKE '{{%' THEN 'bare' ELSE 'prose' END AS form FROM {model_responses} WHERE content IS NOT NULL")
C.add("explanation_templates", "SELECT case_id, '[' || error_type || '] ' || COALESCE(prediction.reason, 'no reason') AS line FROM {case_evidence}")
C.add("stable_ids", "SELECT row_id, substring(sha2(COALESCE(company, '') || '|' || COALESCE(metric, '') || '|' || COALESCE(period, '') || '|' || COALESCE(value, ''), 256), 1, 20) AS id FROM {facts}", "SELECT row_id, substring(sha256(COALESCE(company, '') || '|' || COALESCE(metric, '') || '|' || COALESCE(period, '') || '|' || COALESCE(value, '')), 1, 20) AS id FROM {facts}")
_CHARS = "SELECT case_id, c, COUNT(*) AS n FROM (SELECT case_id, explode(split({f}, '')) AS c FROM x) t WHERE c <> '' GROUP BY case_id, c"
_BAG = """WITH x AS (SELECT case_id, sp.text AS a, sp.original_text AS b FROM (SELECT case_id, {first} AS sp FROM {{case_evidence}} WHERE gold IS NOT NULL AND {n}(gold.spans) > 0) t WHERE sp.text IS NOT NULL AND sp.original_text IS NOT NULL),
  p AS ({p}), q AS ({q}), j AS (SELECT COALESCE(p.case_id, q.case_id) AS case_id, COALESCE(p.n, 0) AS m, COALESCE(q.n, 0) AS n FROM p FULL OUTER JOIN q ON p.case_id = q.case_id AND p.c = q.c)
  SELECT case_id, CAST(ROUND(CAST(SUM(LEAST(m, n)) AS DOUBLE) / CAST(SUM(GREATEST(m, n)) AS DOUBLE), 4) AS DECIMAL(9,4)) AS agreement FROM j GROUP BY case_id"""
_DCHARS = "SELECT case_id, c, COUNT(*) AS n FROM (SELECT case_id, unnest(string_split({f}, '')) AS c FROM x) t WHERE c <> '' GROUP BY case_id, c"
C.add("bag_agreement", _BAG.format(first="gold.spans[0]", n="size", p=_CHARS.format(f="a"), q=_CHARS.format(f="b")), _BAG.format(first="gold.spans[1]", n="len", p=_DCHARS.format(f="a"), q=_DCHARS.format(f="b")))
# bag_agreement compares the first span of a case only; here every span has a row, null where a text is missing or both are empty
_EVERY = """WITH x AS ({x}), c AS (SELECT case_id, span_index, c, SUM(m) AS m, SUM(n) AS n FROM (
    SELECT case_id, span_index, {a} AS c, 1 AS m, 0 AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT case_id, span_index, {b} AS c, 0 AS m, 1 AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL) t
    WHERE c <> '' GROUP BY case_id, span_index, c),
  j AS (SELECT case_id, span_index, CAST(ROUND(CAST(SUM(LEAST(m, n)) AS DOUBLE) / CAST(SUM(GREATEST(m, n)) AS DOUBLE), 4) AS DECIMAL(9,4)) AS agreement FROM c GROUP BY case_id, span_index)
  SELECT x.case_id, x.span_index, j.agreement FROM x LEFT JOIN j ON x.case_id = j.case_id AND x.span_index = j.span_index"""
C.add(
    "bag_agreement_whole",
    _EVERY.format(x="SELECT case_id, span_index, sp.text AS a, sp.original_text AS b FROM {case_evidence} LATERAL VIEW posexplode(gold.spans) t AS span_index, sp", a="explode(split(a, ''))", b="explode(split(b, ''))"),
    _EVERY.format(x="SELECT case_id, span_index, sp.text AS a, sp.original_text AS b FROM (SELECT case_id, CAST(unnest(range(len(gold.spans))) AS INT) AS span_index, unnest(gold.spans) AS sp FROM {case_evidence} WHERE gold IS NOT NULL) t", a="unnest(string_split(a, ''))", b="unnest(string_split(b, ''))"),
)
C.add("sentence_split", "SELECT item_id, size(filter(split(text, '[。！？!?]+'), s -> TRIM(s) <> '')) AS sentences FROM {eval_items}", "SELECT item_id, CAST(len(list_filter(regexp_split_to_array(text, '[。！？!?]+'), lambda s: TRIM(s) <> '')) AS INT) AS sentences FROM {eval_items}")
# sentence_split is over the 240 items; this is over the corpus: null for a null text, pieces of blanks and line ends are no sentences
_PARTS = "SELECT doc_id, CASE WHEN text IS NOT NULL THEN {n} END AS sentences FROM {{documents}}"
C.add(
    "sentence_split_documents",
    _PARTS.format(n="size(filter(split(text, '[。！？!?]+'), s -> regexp_like(s, '[^ \t\r\n　]')))"),
    _PARTS.format(n="CAST(len(list_filter(regexp_split_to_array(text, '[。！？!?]+'), lambda s: regexp_matches(s, '[^ \t\r\n　]'))) AS INT)"),
)
C.add("auto_confirm", "SELECT case_id, CASE WHEN prediction.validation = 'verified' AND NOT prediction.invalid_anchor THEN 'confirm' ELSE 'review' END AS decision FROM {case_evidence} WHERE prediction IS NOT NULL")
QUERIES, SQL = C.queries, C.sql
