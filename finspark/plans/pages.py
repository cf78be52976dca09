"""Boxes, bands, columns and quality of pages."""

from __future__ import annotations

from finspark.operators import layout
from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()


def _boxes(i: int) -> str:
    b = [f"bbox[{k + i}]" for k in range(4)]
    return f"k AS (SELECT block_key, doc_id, run_id, page, block_type, level, block_order, text, caption, {b[0]} AS x0, {b[1]} AS y0, {b[2]} AS x1, {b[3]} AS y1 FROM {{blocks}} WHERE bbox IS NOT NULL)"


def _add(name: str, rest: str) -> None:
    C.add(name, "WITH " + _boxes(0) + rest, "WITH " + _boxes(1) + rest)


_OVER = "CAST(ROUND(GREATEST({}) , 3) AS DECIMAL(12,3))"
C.add("bbox_missing", "SELECT level, COUNT(*) AS n FROM {blocks} WHERE bbox IS NULL GROUP BY level")
_add("bbox_validate", " SELECT block_key, CASE WHEN LEAST(x1 - x0, y1 - y0) < 0.5 THEN 'bbox_degenerate' WHEN x0 < -2 OR y0 < -2 OR x1 > 597 OR y1 > 844 THEN 'out_of_page' ELSE 'ok' END AS state FROM k")
_add("bbox_clamp", " SELECT block_key, CAST(ROUND(GREATEST(0, LEAST(x0, 595)), 2) AS DECIMAL(10,2)) AS x0, CAST(ROUND(GREATEST(0, LEAST(y1, 842)), 2) AS DECIMAL(10,2)) AS y1 FROM k")
_add("page_violations", " SELECT doc_id, run_id, page, COUNT(CASE WHEN LEAST(x1 - x0, y1 - y0) < 0.5 THEN 1 END) AS degenerate, COUNT(CASE WHEN x1 > 597 OR y1 > 844 THEN 1 END) AS outside, COUNT(*) AS blocks FROM k GROUP BY doc_id, run_id, page")
_add("furniture_band", " SELECT block_key FROM k WHERE y1 <= 40 OR y0 >= 802")
_add("area_ratios", " SELECT doc_id, run_id, page, CAST(ROUND(SUM((x1 - x0) * (y1 - y0)) / (595.0 * 842.0), 4) AS DECIMAL(12,4)) AS covered FROM k GROUP BY doc_id, run_id, page")
_add("column_switches", " SELECT doc_id, run_id, page, COUNT(CASE WHEN side <> prev THEN 1 END) AS switches FROM (SELECT doc_id, run_id, page, side, LAG(side) OVER (PARTITION BY doc_id, run_id, page ORDER BY block_order, block_key) AS prev FROM (SELECT *, CASE WHEN (x0 + x1) / 2 < 297.5 THEN 'L' ELSE 'R' END AS side FROM k WHERE x1 - x0 < 327) a) b GROUP BY doc_id, run_id, page")
_add("backward_jumps", " SELECT doc_id, run_id, page, COUNT(CASE WHEN y1 <= py THEN 1 END) AS jumps FROM (SELECT doc_id, run_id, page, y1, LAG(y0) OVER (PARTITION BY doc_id, run_id, page ORDER BY block_order, block_key) AS py FROM k) t GROUP BY doc_id, run_id, page")
_add("axis_gaps", " SELECT doc_id, run_id, page, CAST(ROUND(reach, 2) AS DECIMAL(10,2)) AS lo, CAST(ROUND(y0, 2) AS DECIMAL(10,2)) AS hi FROM (SELECT doc_id, run_id, page, y0, MAX(y1) OVER (PARTITION BY doc_id, run_id, page ORDER BY y0, y1, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k) t WHERE y0 - reach >= 8")
_add("band_order", """, f AS (SELECT *, CASE WHEN x1 - x0 >= 327 THEN 1 ELSE 0 END AS wide FROM k), b AS (SELECT *, SUM(wide) OVER (PARTITION BY doc_id, run_id, page ORDER BY y0, x0, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM f)
  SELECT block_key, CAST(row_number() OVER (PARTITION BY doc_id, run_id, page ORDER BY band, CASE WHEN wide = 1 THEN 0 WHEN (x0 + x1) / 2 < 297.5 THEN 1 ELSE 2 END, y0, x0, block_key) AS INT) AS place FROM b""")  # fmt: skip
_add("caption_nearest", """ , c AS (SELECT * FROM k WHERE block_type = 'text' AND length(text) <= 60), t AS (SELECT * FROM k WHERE block_type = 'table'),
  j AS (SELECT c.block_key AS caption_key, t.block_key AS table_key, t.y0 - c.y1 AS dist FROM c JOIN t ON c.doc_id = t.doc_id AND c.run_id = t.run_id AND c.page = t.page WHERE t.y0 - c.y1 BETWEEN -8 AND 160)
  SELECT caption_key, table_key FROM (SELECT caption_key, table_key, row_number() OVER (PARTITION BY caption_key ORDER BY dist, table_key) AS rn, COUNT(*) OVER (PARTITION BY caption_key, dist) AS same FROM j) x WHERE rn = 1 AND same = 1""")  # fmt: skip
_add("inside_table_drop", " SELECT a.block_key FROM k a WHERE a.block_type = 'text' AND NOT EXISTS (SELECT 1 FROM k t WHERE t.block_type = 'table' AND t.doc_id = a.doc_id AND t.run_id = a.run_id AND t.page = a.page AND t.x0 <= a.x0 AND t.y0 <= a.y0 AND t.x1 >= a.x1 AND t.y1 >= a.y1)")
_add("page_quality", """ SELECT doc_id, run_id, page, COUNT(*) AS blocks, CAST(SUM(length(COALESCE(text, ''))) AS BIGINT) AS chars, CASE WHEN SUM(length(COALESCE(text, ''))) = 0 THEN 'fail' WHEN SUM(length(COALESCE(text, ''))) < 30 OR COUNT(CASE WHEN LEAST(x1 - x0, y1 - y0) < 0.5 THEN 1 END) > 0 THEN 'warn' ELSE 'ok' END AS status FROM k GROUP BY doc_id, run_id, page""")
_add("doc_quality", """, p AS (SELECT doc_id, run_id, page, CASE WHEN SUM(length(COALESCE(text, ''))) = 0 THEN 2 WHEN SUM(length(COALESCE(text, ''))) < 30 THEN 1 ELSE 0 END AS sev FROM k GROUP BY doc_id, run_id, page) SELECT doc_id, run_id, MAX(sev) AS worst, COUNT(CASE WHEN sev > 0 THEN 1 END) AS flagged, COUNT(*) AS pages FROM p GROUP BY doc_id, run_id""")
_add("rotated_boxes", " SELECT block_key, CAST(ROUND(842 - y1, 2) AS DECIMAL(10,2)) AS x0, CAST(ROUND(842 - y0, 2) AS DECIMAL(10,2)) AS x1 FROM k")
_add("heading_class", " SELECT block_key, CASE WHEN y1 - y0 >= 20 AND length(text) <= 60 AND NOT regexp_like(text, '[。.!?！？]$') THEN 'heading' ELSE 'body' END AS kind FROM k WHERE text IS NOT NULL".replace("regexp_like", "regexp_like"))
C.sql["heading_class"] = C.sql["heading_class"].replace("regexp_like(", "regexp_matches(")
_add("median_height", " SELECT doc_id, CAST(ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY y1 - y0), 3) AS DECIMAL(12,3)) AS median_height FROM k GROUP BY doc_id")
C.add("page_coverage", "SELECT doc_id, run_id, MIN(page) AS first_page, MAX(page) AS last_page, MAX(page) - MIN(page) + 1 - COUNT(DISTINCT page) AS missing_pages FROM {ocr_lines} WHERE page IS NOT NULL GROUP BY doc_id, run_id")
C.add("ocr_page_select", "SELECT doc_id, run_id, page FROM {ocr_lines} GROUP BY doc_id, run_id, page HAVING SUM(length(COALESCE(text, ''))) < 300 OR MIN(score) < 0.8")
C.add("page_sampling", "SELECT doc_id, run_id, page FROM (SELECT doc_id, run_id, page, row_number() OVER (PARTITION BY doc_id, run_id ORDER BY page) AS rn FROM (SELECT DISTINCT doc_id, run_id, page FROM {ocr_lines}) p) t WHERE rn % 3 = 1")
_CELLS = "SELECT block_key, c.row_no AS r, c.col_no AS c, c.text AS t FROM (SELECT block_key, {x}(cells) AS c FROM {{blocks}} WHERE block_type = 'table') q"
for _n, _rest in {
    "table_stats": " SELECT block_key, COUNT(*) AS cells, COUNT(CASE WHEN t IS NULL OR TRIM(t) = '' THEN 1 END) AS empty_cells, COUNT(DISTINCT r) AS table_rows, COUNT(DISTINCT c) AS table_cols FROM g GROUP BY block_key",
    "table_usability": " SELECT block_key, CASE WHEN COUNT(DISTINCT r) >= 2 AND COUNT(DISTINCT c) >= 2 AND COUNT(CASE WHEN TRIM(t) <> '' THEN 1 END) * 5 >= COUNT(*) THEN TRUE ELSE FALSE END AS usable FROM g GROUP BY block_key",
    "inconsistent_rows": " SELECT block_key, COUNT(DISTINCT n) AS widths FROM (SELECT block_key, r, COUNT(*) AS n FROM g GROUP BY block_key, r) w GROUP BY block_key",
    "cell_header_lookup": " SELECT a.block_key, a.r, a.c, h.t AS head FROM g a LEFT JOIN (SELECT block_key, c, t FROM g WHERE r = 0) h ON a.block_key = h.block_key AND a.c = h.c WHERE a.r > 0",
}.items():
    C.add(_n, "WITH g AS (" + _CELLS.format(x="explode") + ")" + _rest, "WITH g AS (" + _CELLS.format(x="unnest") + ")" + _rest)
C.add("failure_list", "SELECT doc_id, run_id, COUNT(CASE WHEN score < 0.8 THEN 1 END) AS weak_lines, CAST(ROUND(AVG(score), 4) AS DECIMAL(9,4)) AS mean_score FROM {ocr_lines} GROUP BY doc_id, run_id")
C.add("sentence_boxes", "SELECT block_key, s.char_start AS a, s.char_end AS b, length(s.text) AS n FROM (SELECT block_key, explode(sentences) AS s FROM {blocks}) t", "SELECT block_key, s.char_start AS a, s.char_end AS b, length(s.text) AS n FROM (SELECT block_key, unnest(sentences) AS s FROM {blocks}) t")
C.frame("xy_cut", lambda spark, d: layout.reading_order(table(spark, d, "blocks")))
QUERIES, SQL = C.queries, C.sql
