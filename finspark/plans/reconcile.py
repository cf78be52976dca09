"""Reconciliation of claimed against source facts, and checks of facts among themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.functions import notation as N
from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()

_YEARLY = """
  SELECT n.n_name AS company, CAST(year(o.o_orderdate) AS INT) AS yr,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS yuan
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, year(o.o_orderdate), n.n_nationkey"""

# claims print the source in ten thousands with two decimals, some of them falsified by a fixed rule
_CLAIMS = f"""
WITH src AS (
  SELECT n.n_name AS company, n.n_nationkey AS k, CAST(year(o.o_orderdate) AS INT) AS yr,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS yuan
  FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, n.n_nationkey, year(o.o_orderdate)),
claim AS (
  SELECT a.company, a.yr, a.k,
         CAST(ROUND(CASE (a.k + a.yr) % 5 WHEN 0 THEN a.yuan * CAST(1.08 AS DECIMAL(4,2)) WHEN 2 THEN COALESCE(b.yuan, a.yuan) ELSE a.yuan END
              * CAST(0.0001 AS DECIMAL(10,4)), 2) AS DECIMAL(20,2)) AS val,
         CASE WHEN (a.k + a.yr) % 5 = 1 THEN 'yi' ELSE 'wan' END AS unit
  FROM src a LEFT JOIN src b ON a.company = b.company AND a.yr = b.yr + 1),
shown AS (
  SELECT company, yr, CAST(ROUND(yuan * CAST(0.0001 AS DECIMAL(10,4)), 2) AS DECIMAL(20,2)) AS wan,
         CAST(ROUND(yuan * CAST(0.00000001 AS DECIMAL(10,8)), 2) AS DECIMAL(20,2)) AS yi FROM src),
judged AS (
  SELECT c.company, c.yr, c.val, c.unit, s.wan, s.yi,
         CASE WHEN c.unit = 'wan' THEN s.wan ELSE s.yi END AS expected,
         (SELECT COUNT(*) FROM shown o WHERE o.company = c.company AND o.yr <> c.yr AND CASE WHEN c.unit = 'wan' THEN o.wan ELSE o.yi END = c.val) AS elsewhere
  FROM claim c LEFT JOIN shown s ON s.company = c.company AND s.yr = c.yr),
result AS (
  SELECT company, yr, val, unit, expected,
         CASE WHEN expected IS NULL THEN 'needs_review' WHEN val = expected THEN 'no_issue' ELSE 'confirmed_error' END AS status,
         CASE WHEN expected IS NULL OR val = expected THEN 'none'
              WHEN val = wan OR val = yi THEN 'unit' WHEN elsewhere = 1 THEN 'period' ELSE 'number' END AS error_type
  FROM judged)
"""
C.add("reconcile_orders_revenue", _CLAIMS + "SELECT company, CAST(yr AS VARCHAR(4)) || 'FY' AS period, val, unit, expected, status, error_type FROM result")
C.add("check_summary", _CLAIMS + "SELECT status, error_type, COUNT(*) AS claims, COUNT(DISTINCT company) AS companies FROM result GROUP BY status, error_type")
C.add(
    "evidence_requests",
    _CLAIMS
    + """, kinds AS (SELECT 'number' AS error_type, 'source_value' AS need, 'metric' AS field UNION ALL SELECT 'unit', 'unit_heading', 'unit'
      UNION ALL SELECT 'period', 'other_period', 'period')
    SELECT r.company, CAST(r.yr AS VARCHAR(4)) || 'FY' AS period, k.need, k.field FROM result r JOIN kinds k ON r.error_type = k.error_type""",
)
C.add(
    "yoy_recompute",
    f"""WITH src AS ({_YEARLY})
    SELECT a.company, a.yr, CAST(ROUND(CAST((a.yuan - b.yuan) AS DOUBLE) / CAST(b.yuan AS DOUBLE) * 100, 4) AS DECIMAL(18,4)) AS yoy_pct
    FROM src a JOIN src b ON a.company = b.company AND a.yr = b.yr + 1 WHERE b.yuan > 0""",
)
C.add(
    "related_metric_pairs",
    """WITH f AS (SELECT row_id, company, period, basis, scope, currency, metric FROM {facts} WHERE metric IN ('net_profit', 'net_profit_parent')
        AND company IS NOT NULL AND period IS NOT NULL AND currency IS NOT NULL AND basis <> 'unknown' AND scope <> 'unknown')
    SELECT a.row_id AS claim_row, b.row_id AS source_row FROM f a JOIN f b ON a.company = b.company AND a.period = b.period AND a.basis = b.basis
      AND a.scope = b.scope AND a.currency = b.currency WHERE a.metric = 'net_profit' AND b.metric = 'net_profit_parent'""",
)
_KNOWN = " AND ".join(f"{c} IS NOT NULL AND TRIM({c}) NOT IN ('', 'unknown')" for c in ("company", "metric", "period", "basis", "scope", "currency"))
C.add(
    "same_context_conflicts",
    f"""SELECT company, metric, period, basis, scope, currency, COUNT(*) AS facts, COUNT(DISTINCT COALESCE(value, '') || ' ' || COALESCE(TRIM(unit), '')) AS printed
    FROM {{facts}} WHERE {_KNOWN} GROUP BY company, metric, period, basis, scope, currency
    HAVING COUNT(DISTINCT COALESCE(value, '') || ' ' || COALESCE(TRIM(unit), '')) > 1""",
)
C.add(
    "identity_value_conflicts",
    "SELECT doc, COUNT(DISTINCT sha) AS shas, COUNT(DISTINCT run) AS runs FROM (SELECT e.doc_id AS doc, e.sha256 AS sha, e.run_id AS run FROM (SELECT explode(evidence) AS e FROM {facts})) GROUP BY doc HAVING COUNT(DISTINCT run) > 1",
    "SELECT doc, COUNT(DISTINCT sha) AS shas, COUNT(DISTINCT run) AS runs FROM (SELECT e.doc_id AS doc, e.sha256 AS sha, e.run_id AS run FROM (SELECT unnest(evidence) AS e FROM {facts})) GROUP BY doc HAVING COUNT(DISTINCT run) > 1",
)
C.add(
    "citation_location_check",
    """WITH e AS (SELECT row_id, value, explode(evidence) AS e FROM {facts})
    SELECT row_id, CASE WHEN e.page IS NULL AND e.paragraph IS NULL THEN 'no_location' WHEN position(TRIM(value) IN e.text) = 0 THEN 'value_not_at_location' ELSE 'ok' END AS outcome
    FROM e WHERE value IS NOT NULL AND TRIM(value) <> ''""",
    """WITH e AS (SELECT row_id, value, unnest(evidence) AS e FROM {facts})
    SELECT row_id, CASE WHEN e.page IS NULL AND e.paragraph IS NULL THEN 'no_location' WHEN position(TRIM(value) IN e.text) = 0 THEN 'value_not_at_location' ELSE 'ok' END AS outcome
    FROM e WHERE value IS NOT NULL AND TRIM(value) <> ''""",
)
_PERIOD = "regexp_like(period, '^[0-9]{{4}}(FY|H1|H2|9M|Q[1-4])$')"
C.add(
    "period_validity",
    f"""SELECT row_id, period, CASE WHEN period IS NULL THEN 'missing' WHEN {_PERIOD} THEN 'span'
      WHEN regexp_like(period, '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$') AND TRY_CAST(period AS DATE) IS NOT NULL THEN 'day' ELSE 'invalid' END AS kind FROM {{facts}}""",
)
C.add(
    "period_mapping",
    f"""SELECT DISTINCT period, substring(period, 1, 4) || CASE substring(period, 5, 2) WHEN 'FY' THEN '-12-31' WHEN 'H2' THEN '-12-31' WHEN 'Q4' THEN '-12-31'
      WHEN 'H1' THEN '-06-30' WHEN 'Q2' THEN '-06-30' WHEN '9M' THEN '-09-30' WHEN 'Q3' THEN '-09-30' ELSE '-03-31' END AS balance_date,
      CAST(CAST(substring(period, 1, 4) AS INT) - 1 AS VARCHAR(4)) || substring(period, 5, 2) AS prior_period FROM {{facts}} WHERE {_PERIOD}""",
)
C.add(
    "prior_day",
    """SELECT DISTINCT period, CAST(TRY_CAST(CAST(CAST(substring(period, 1, 4) AS INT) - 1 AS VARCHAR(4)) || substring(period, 5, 6) AS DATE) AS VARCHAR(10)) AS prior
    FROM {facts} WHERE regexp_like(period, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')""",
)
_REASONS = [("company", "company_missing"), ("metric", "metric_missing"), ("period", "period_missing"), ("basis", "basis_unknown"), ("scope", "scope_unknown"), ("currency", "currency_unknown"), ("unit", "unit_missing"), ("value", "value_missing")]
_BAD = " || ".join(f"CASE WHEN {c} IS NULL OR TRIM({c}) IN ('', 'unknown') THEN '{r};' ELSE '' END" for c, r in _REASONS)
C.add("blocking_reasons", f"SELECT row_id, {_BAD} || CASE WHEN cardinality(evidence) = 0 THEN 'evidence_missing;' ELSE '' END AS reasons FROM {{facts}}".replace("cardinality(evidence)", "size(evidence)"),
      f"SELECT row_id, {_BAD} || CASE WHEN len(evidence) = 0 THEN 'evidence_missing;' ELSE '' END AS reasons FROM {{facts}}")
_DEDUPE = """SELECT row_id, fact_id, warned FROM (SELECT row_id, fact_id, {n}(warnings) AS warned, row_number() OVER (PARTITION BY company, metric, period, basis, scope, currency, value, unit
      ORDER BY {n}(warnings), CASE WHEN {m} THEN 0 ELSE 1 END, row_id) AS rn FROM {{facts}}) t WHERE rn = 1"""
C.add("fact_dedupe_best", _DEDUPE.format(n="size", m="map_contains_key(attributes, 'table')"), _DEDUPE.format(n="len", m="len(map_extract(attributes, 'table')) > 0"))
C.add(
    "unit_term_guard",
    """SELECT row_id, metric, unit, CASE WHEN metric IN ('gross_margin', 'margin_change') THEN 'money_unit_on_ratio' ELSE 'share_amount_too_large' END AS rule FROM {facts}
    WHERE (metric IN ('gross_margin', 'margin_change') AND regexp_like(COALESCE(unit, ''), '[亿万元]'))
       OR (metric = 'eps_basic' AND TRIM(COALESCE(unit, '')) = '元/股' AND TRY_CAST(value AS DOUBLE) > 500)""",
)
C.add(
    "intrinsic_conflict_findings",
    f"""WITH f AS (SELECT row_id, company, metric, period, basis, scope, currency, TRY_CAST(value AS DECIMAL(30,8)) AS v, TRIM(unit) AS unit FROM {{facts}} WHERE {_KNOWN} AND regexp_like(TRIM(value), '^-?[0-9]{{{{1,15}}}}([.][0-9]{{{{1,8}}}})?$')),
    p AS (SELECT a.company, a.metric, a.period, a.basis, a.scope, a.currency, a.row_id AS a, b.row_id AS b FROM f a JOIN f b ON a.company = b.company AND a.metric = b.metric
      AND a.period = b.period AND a.basis = b.basis AND a.scope = b.scope AND a.currency = b.currency AND a.unit = b.unit WHERE a.row_id < b.row_id AND a.v <> b.v)
    SELECT company, metric, period, basis, scope, currency, MIN(a) AS first_row, MAX(b) AS last_row, COUNT(*) AS pairs FROM p GROUP BY company, metric, period, basis, scope, currency""",
)
C.add(
    "quantity_normalize",
    """SELECT row_id, CAST(TRY_CAST(value AS DECIMAL(20,6)) * CASE TRIM(unit) WHEN '元' THEN 1 WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 WHEN '百万元' THEN 1000000 WHEN '亿元' THEN 100000000 END AS DECIMAL(38,6)) AS yuan
    FROM {facts} WHERE TRIM(unit) IN ('元', '千元', '万元', '百万元', '亿元') AND TRY_CAST(value AS DECIMAL(20,6)) IS NOT NULL AND regexp_like(TRIM(value), '^-?[0-9]{{1,12}}([.][0-9]+)?$') AND length(TRIM(value)) <= 14""",
)
_UNITS = "(SELECT '元' AS unit, 'money' AS dimension UNION ALL SELECT '万元', 'money' UNION ALL SELECT '亿元', 'money' UNION ALL SELECT '股', 'share' UNION ALL SELECT '%', 'percent' UNION ALL SELECT '百分点', 'point' UNION ALL SELECT '吨', 'mass')"
C.add("unit_dimension_lookup", f"SELECT COALESCE(u.dimension, 'other') AS dimension, COUNT(*) AS facts FROM {{facts}} f LEFT JOIN {_UNITS} u ON TRIM(f.unit) = u.unit GROUP BY COALESCE(u.dimension, 'other')")
C.add("title_year_mode", "SELECT doc, yr, n, years FROM (SELECT doc, yr, n, COUNT(*) OVER (PARTITION BY doc) AS years, row_number() OVER (PARTITION BY doc ORDER BY n DESC, yr) AS rn FROM (SELECT company AS doc, substring(period, 1, 4) AS yr, COUNT(*) AS n FROM {facts} WHERE period IS NOT NULL AND length(period) >= 6 AND company IS NOT NULL GROUP BY company, substring(period, 1, 4)) t) u WHERE rn = 1")
C.add("new_claim_antijoin", "SELECT DISTINCT a.fact_id FROM {facts} a LEFT JOIN (SELECT DISTINCT metric, value, unit, period FROM {facts} WHERE basis = 'reported') b ON a.metric = b.metric AND a.value = b.value AND a.unit = b.unit AND a.period = b.period WHERE a.basis <> 'reported' AND b.metric IS NULL")
C.add("micro_unit_ceiling", "SELECT request_id, CAST(CEIL(CAST(usage.cost_cny AS DECIMAL(18,8)) * 1000000) AS BIGINT) AS micro FROM {run_results} WHERE usage IS NOT NULL AND usage.cost_cny IS NOT NULL")
C.add("lenient_number", "SELECT row_id, TRY_CAST(replace(regexp_extract(value, '-?[0-9][0-9,]*[.]?[0-9]*', 0), ',', '') AS DECIMAL(34,15)) AS v FROM {facts} WHERE length(value) < 16 AND regexp_like(value, '[0-9]')")


def _read(spark, d, *columns):
    """Facts with ``n``, the exact number of ``value`` (null where unreadable), and ``unit_of``, dim and e10 of their unit.

    The unit is that of ``unit``, else the one behind the number; a number before other words, or before another unit
    than ``unit`` names, is unreadable.
    """
    names = spark.createDataFrame(N.unit_table(), "name string, dim string, e10 int")
    f = table(spark, d, "facts").select("row_id", *columns, F.trim("unit").alias("unit"), N.squeeze(F.col("unit")).alias("u1"), N.parse_number(F.col("value")).alias("n"))
    f = f.withColumn("u2", N.squeeze(F.col("n.suffix")))
    for key, out in (("u1", "f1"), ("u2", "f2")):
        f = f.join(F.broadcast(names.select(F.col("name").alias(key), F.struct("dim", "e10").alias(out))), key, "left")
    same = F.col("f2").isNotNull() & (F.col("f1").isNull() | (F.col("f1") == F.col("f2")))
    exact = (F.col("u2") == "") | (F.col("u1") == F.col("u2")) | same
    return f.select("row_id", *columns, "unit", F.when(exact, F.col("n")).alias("n"), F.coalesce("f1", "f2").alias("unit_of"))


def _plain(e10):
    return F.when(F.col("n.digits") == "0", F.lit("0")).otherwise(N.plain(F.col("n.sign"), F.col("n.digits"), e10))


def _normalized(spark, d):
    """row_id, value (exact decimal string), unit: one row per fact, in the common unit; both null where it cannot be read.

    quantity_normalize takes plain ASCII numbers of at most 14 characters in five money units, as its SQL states.
    """
    told = F.col("n").isNotNull() & F.col("unit_of").isNotNull()
    common = F.lit(None).cast("string")
    for k, v in N.COMMON.items():
        common = F.when(F.col("unit_of.dim") == k, v).otherwise(common)
    return _read(spark, d).select("row_id", F.when(told, _plain(F.col("n.e10") + F.col("unit_of.e10"))).alias("value"), F.when(told, common).alias("unit"))


def _first_number(spark, d):
    """row_id, v: one row per fact with the first number in ``value`` as an exact decimal string, null where there is none.

    lenient_number drops values of 16 characters and more and full-width digits, as its SQL states. Dollar signs go
    first, as in the reference (scorers.py, to_number); commas are dropped, brackets and exponents are not read.
    """
    first = F.regexp_extract(F.replace(N.to_half_width(F.col("value")), F.lit("$"), F.lit("")), "-?[0-9][0-9,]*(?:[.][0-9]+)?", 0)
    return table(spark, d, "facts").select("row_id", N.parse_number(F.replace(first, F.lit(","), F.lit(""))).alias("n")).select("row_id", _plain(F.col("n.e10")).alias("v"))


def _conflicts(spark, d):
    """The columns of intrinsic_conflict_findings over every exact number, not only plain ones of 15 digits.

    Facts of one unit at one scale are compared, in any spelling of it; units that are not in the table as they are
    printed. Pairs are counted from the rows of each value, (n * n - sum of squares) / 2, and none is built.
    """
    keys = ["company", "metric", "period", "basis", "scope", "currency"]
    f = _read(spark, d, *keys).where(_KNOWN).where("n is not null and (unit_of is not null or unit is not null)")
    f = f.withColumn("same", F.coalesce(F.concat_ws(" ", "unit_of.dim", "unit_of.e10"), F.lit(""))).withColumn("printed", F.when(F.col("unit_of").isNull(), F.col("unit")))
    v = f.groupBy(*keys, "same", "printed", "n.sign", "n.digits", "n.e10").agg(F.count("*").alias("k"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    g = v.groupBy(*keys, "same", "printed").agg(F.count("*").alias("values"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.where("values > 1").groupBy(*keys).agg(F.min("lo").alias("first_row"), F.max("hi").alias("last_row"), F.sum(F.expr("(n * n - sq) div 2")).alias("pairs"))


C.frame("quantity_normalize_whole", _normalized)
C.frame("lenient_number_whole", _first_number)
C.frame("intrinsic_conflict_findings_whole", _conflicts)
QUERIES, SQL = C.queries, C.sql
