"""Spans of text: overlap, containment, union, gaps and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.operators import matching
from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()
_SPANS = "s AS (SELECT case_id, document_id, error_type, arm, result, sp.span_start AS a, sp.span_end AS b, sp.text AS text FROM (SELECT case_id, document_id, error_type, arm, result, {x}(gold.spans) AS sp FROM {{case_evidence}} WHERE gold IS NOT NULL) t WHERE sp.span_start IS NOT NULL AND sp.span_end > sp.span_start)"


def _both(name: str, rest: str) -> None:
    C.add(name, "WITH " + _SPANS.format(x="explode") + rest, "WITH " + _SPANS.format(x="unnest") + rest)


_both("span_overlap_join", " SELECT x.case_id AS case_a, y.case_id AS case_b, GREATEST(x.a, y.a) AS lo, LEAST(x.b, y.b) AS hi FROM s x JOIN s y ON x.document_id = y.document_id WHERE x.case_id < y.case_id AND x.a < y.b AND y.a < x.b")
_both("span_containment", " SELECT DISTINCT x.case_id AS outer_case, y.case_id AS inner_case FROM s x JOIN s y ON x.document_id = y.document_id WHERE x.case_id <> y.case_id AND x.a <= y.a AND y.b <= x.b")
_MERGED = """, f AS (SELECT document_id, a, b, CASE WHEN a <= MAX(b) OVER (PARTITION BY document_id ORDER BY a, b, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, case_id FROM s),
  g AS (SELECT document_id, a, b, SUM(fresh) OVER (PARTITION BY document_id ORDER BY a, b, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
  m AS (SELECT document_id, MIN(a) AS lo, MAX(b) AS hi FROM g GROUP BY document_id, island)"""
_both("merge_ranges", _MERGED + " SELECT document_id, lo, hi FROM m")
_both("missing_ranges", _MERGED + """, d AS (SELECT document_id, MAX(length(content)) AS n FROM {inputs_research442} WHERE content IS NOT NULL GROUP BY document_id)
  SELECT m.document_id, LAG(m.hi, 1, 0) OVER (PARTITION BY m.document_id ORDER BY m.lo) AS gap_start, m.lo AS gap_end FROM m JOIN d ON d.document_id = m.document_id
  UNION ALL SELECT d.document_id, MAX(m.hi), CAST(MAX(d.n) AS INT) FROM m JOIN d ON d.document_id = m.document_id GROUP BY d.document_id""")  # fmt: skip
_both("adjacent_overlap", " SELECT case_id, a, b, nxt FROM (SELECT case_id, a, b, LEAD(a) OVER (PARTITION BY case_id ORDER BY a, b) AS nxt FROM s) t WHERE nxt < b")
_both("invalid_anchor_audit", """ SELECT s.case_id, s.a, s.b, CASE WHEN i.content IS NULL THEN 'no_content' WHEN s.text IS NULL THEN 'no_text' WHEN substring(i.content, s.a + 1, s.b - s.a) = s.text THEN 'exact' WHEN position(s.text IN i.content) > 0 THEN 'moved' ELSE 'unresolved' END AS outcome
  FROM s LEFT JOIN (SELECT document_id, MIN(content) AS content FROM {inputs_research442} GROUP BY document_id) i ON i.document_id = s.document_id""")  # fmt: skip
_both("anchor_spans_exact", """, i AS (SELECT document_id, MIN(content) AS content FROM {inputs_research442} WHERE content IS NOT NULL GROUP BY document_id),
  n AS (SELECT s.case_id, s.a, s.b, CAST((length(i.content) - length(replace(i.content, s.text, ''))) / length(s.text) AS INT) AS hits, position(s.text IN i.content) AS first FROM s JOIN i ON i.document_id = s.document_id WHERE length(s.text) > 0)
  SELECT case_id, a, b, hits, CASE WHEN hits = 0 THEN 'unresolved' WHEN hits > 1 THEN 'ambiguous' WHEN first = a + 1 THEN 'at_offset' ELSE 'unique_elsewhere' END AS anchor FROM n""")  # fmt: skip
_both("normalize_adjacent_spans", """, j AS (SELECT case_id, a, b, CASE WHEN a <= MAX(b) OVER (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM s),
  g AS (SELECT case_id, a, b, SUM(fresh) OVER (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM j) SELECT case_id, MIN(a) AS lo, MAX(b) AS hi, COUNT(*) AS parts FROM g GROUP BY case_id, island""")  # fmt: skip
_both("limitation_projection", " SELECT case_id, GREATEST(a, 200) AS lo, LEAST(b, 600) AS hi FROM s WHERE a < 600 AND b > 200")
C.add("running_block_offsets", "SELECT block_key, doc_id, CAST(COALESCE(SUM(length(COALESCE(text, '')) + 1) OVER (PARTITION BY doc_id, run_id ORDER BY page, block_order, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM {blocks}")
_TEXTS = """SELECT doc_id, {agg} AS text FROM (SELECT doc_id, page, block_order, block_key, text FROM {{blocks}} WHERE text IS NOT NULL AND level <> 'ocr') t GROUP BY doc_id"""
C.add("ordered_text_assembly", _TEXTS.format(agg="array_join(transform(array_sort(collect_list(struct(page, block_order, block_key, text))), x -> x.text), '|')"), _TEXTS.format(agg="string_agg(text, '|' ORDER BY page, block_order, block_key)"))
_EDIT = "SELECT case_id, {e} AS changed FROM {{case_evidence}} c JOIN (SELECT document_id AS d, MIN(content) AS content FROM {{inputs_research442}} WHERE content IS NOT NULL GROUP BY document_id) i ON c.document_id = i.d WHERE gold IS NOT NULL AND {n}(gold.spans) = 1 AND {s}.span_start IS NOT NULL AND {s}.span_end IS NOT NULL AND {s}.span_end >= {s}.span_start AND {s}.text IS NOT NULL"
_E = "substring(content, 1, {s}.span_start) || {s}.text || substring(content, {s}.span_end + 1, length(content))"
C.add("apply_edits", _EDIT.format(e=_E.format(s="gold.spans[0]"), n="size", s="gold.spans[0]"), _EDIT.format(e=_E.format(s="gold.spans[1]"), n="len", s="gold.spans[1]"))


def _spliced(spark, d):
    """case_id, changed, outcome: one row per case with gold, all its spans put into the content from right to left.

    apply_edits takes cases of one span only, as its SQL states. Of equal starts the longer span goes first, then
    the earlier one of the list. changed is null where outcome is not ``spliced``: ``no_content``, ``bad_span`` (null
    offset or text, or offsets outside the content), ``overlapping_spans``. Without spans the content stays as it is.
    """
    content = table(spark, d, "inputs_research442").where("content is not null").groupBy("document_id").agg(F.min("content").alias("content"))
    s = table(spark, d, "case_evidence").where("gold is not null").select("case_id", "document_id", F.coalesce("gold.spans", F.array()).alias("spans"))
    s = s.join(content, "document_id", "left").withColumn("bad", F.exists("spans", lambda x: ~F.coalesce((x["span_start"] >= 0) & (x["span_start"] <= x["span_end"]) & (x["span_end"] <= F.length("content")) & x["text"].isNotNull(), F.lit(False))))
    last = F.array_sort(F.transform("spans", lambda x, i: F.struct((-x["span_start"]).alias("a"), (-x["span_end"]).alias("b"), i.alias("i"), x["text"].alias("text"))))
    s = s.withColumn("last", last).withColumn("crossed", F.exists(F.sequence(F.lit(1), F.greatest(F.size("last") - 1, F.lit(1))), lambda i: F.get("last", i)["b"] < F.get("last", i - 1)["a"]))
    outcome = F.when(F.col("content").isNull(), "no_content").when(F.col("bad"), "bad_span").when(F.coalesce("crossed", F.lit(False)), "overlapping_spans").otherwise("spliced")
    text = F.aggregate("last", F.col("content"), lambda t, x: F.concat(F.substring(t, F.lit(1), -x["a"]), x["text"], F.substring(t, 1 - x["b"], F.length(t))))
    return s.select("case_id", F.when(outcome == "spliced", text).alias("changed"), outcome.alias("outcome"))


C.frame("apply_edits_whole", _spliced)


def _matching(spark, d):
    s = table(spark, d, "case_evidence").where("gold is not null").select("document_id", "case_id", "arm", F.explode("gold.spans").alias("s"))
    s = s.select("document_id", "case_id", "arm", F.col("s.span_start").alias("a"), F.col("s.span_end").alias("b")).where("a < b")
    x, y = s.alias("x"), s.alias("y")
    edges = x.join(y, (F.col("x.document_id") == F.col("y.document_id")) & (F.col("x.arm") < F.col("y.arm")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b")))
    return matching.matched_counts(edges.select("x.document_id", F.col("x.case_id").alias("p"), F.col("y.case_id").alias("g")), "document_id", "p", "g")


C.frame("max_matching_score", _matching)
QUERIES, SQL = C.queries, C.sql
