"""Interval arithmetic on printed numbers: what is printed is a range of half a unit in the last place either way."""

from __future__ import annotations

from finspark.plans.shared import Catalog

C = Catalog()

C.add(
    "display_intervals",
    """SELECT l_orderkey, l_linenumber, CAST(v - 0.005 AS DECIMAL(20,4)) AS lo, CAST(v + 0.005 AS DECIMAL(20,4)) AS hi FROM
    (SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS v FROM {lineitem}) t""",
)
_MONTH = """m AS (SELECT p.p_brand AS item, CAST(year(l.l_shipdate) AS INT) AS yr, CAST(AVG(l.l_extendedprice / l.l_quantity) AS DECIMAL(18,2)) AS price,
    CAST(SUM(l.l_quantity) AS DECIMAL(18,0)) AS qty FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 0 GROUP BY p.p_brand, year(l.l_shipdate))"""
_MONTH = _MONTH.replace("CAST(AVG(l.l_extendedprice / l.l_quantity) AS DECIMAL(18,2))", "CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) / SUM(CAST(l.l_quantity AS DECIMAL(18,0))), 1) AS DECIMAL(18,1))")
_CHANGE = """SELECT a.item, a.yr, CAST(a.{x} AS DECIMAL(18,2)) AS cur, CAST(a.{x} - b.{x} AS DECIMAL(18,2)) AS diff,
    CAST(ROUND(CAST(a.{x} - b.{x} - {e} AS DOUBLE) / CAST(b.{x} + {e} AS DOUBLE) * 100, 3) AS DECIMAL(18,3)) AS lo_pct,
    CAST(ROUND(CAST(a.{x} - b.{x} + {e} AS DOUBLE) / CAST(b.{x} - {e} AS DOUBLE) * 100, 3) AS DECIMAL(18,3)) AS hi_pct
    FROM m a JOIN m b ON a.item = b.item AND a.yr = b.yr + 1 WHERE b.{x} > 1"""
C.add("price_change_interval", "WITH " + _MONTH + " " + _CHANGE.format(x="price", e="0.05"))
C.add("inventory_change_interval", "WITH " + _MONTH + " " + _CHANGE.format(x="qty", e="0.5"))
C.add(
    "component_sum_interval",
    """WITH part_sum AS (SELECT l_orderkey, COUNT(*) AS parts, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM {lineitem} GROUP BY l_orderkey HAVING COUNT(*) BETWEEN 2 AND 8)
    SELECT l_orderkey, parts, CAST(total AS DECIMAL(20,2)) AS printed, CAST(total - 0.005 * parts AS DECIMAL(20,3)) AS lo, CAST(total + 0.005 * parts AS DECIMAL(20,3)) AS hi FROM part_sum""",
)
C.add(
    "share_interval",
    """WITH r AS (SELECT n.n_regionkey AS rk, n.n_name AS name, CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS v FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_regionkey, n.n_name),
    t AS (SELECT rk, CAST(SUM(v) AS DECIMAL(20,2)) AS total FROM r GROUP BY rk)
    SELECT r.rk, r.name, CAST(ROUND(CAST(r.v - 0.005 AS DOUBLE) / CAST(t.total + 0.005 AS DOUBLE) * 100, 3) AS DECIMAL(18,3)) AS lo_pct,
      CAST(ROUND(CAST(r.v + 0.005 AS DOUBLE) / CAST(t.total - 0.005 AS DOUBLE) * 100, 3) AS DECIMAL(18,3)) AS hi_pct FROM r JOIN t ON r.rk = t.rk WHERE t.total > 1""",
)
C.add(
    "price_eps_pe",
    """WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size AS DECIMAL(18,2)) AS pe FROM {part} WHERE p_size > 0)
    SELECT p_partkey, price, CAST(FLOOR(CAST(price AS DOUBLE) / CAST(pe AS DOUBLE) * 100 + 0.500001) / 100 AS DECIMAL(18,2)) AS eps,
      CASE WHEN price BETWEEN (CAST(FLOOR(CAST(price AS DOUBLE) / CAST(pe AS DOUBLE) * 100 + 0.500001) / 100 AS DECIMAL(18,2)) - 0.005) * (pe - 0.5) AND (CAST(FLOOR(CAST(price AS DOUBLE) / CAST(pe AS DOUBLE) * 100 + 0.500001) / 100 AS DECIMAL(18,2)) + 0.005) * (pe + 0.5) THEN TRUE ELSE FALSE END AS compatible FROM p""",
)
_MONTHLY = "WITH t AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v, LAG(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders})"
C.add(
    "growth_sign_runs",
    _MONTHLY + """, s AS (SELECT o_custkey, rn, CASE WHEN v > p THEN 1 WHEN v < p THEN -1 ELSE 0 END AS sign FROM t WHERE p IS NOT NULL),
    g AS (SELECT o_custkey, sign, rn - row_number() OVER (PARTITION BY o_custkey, sign ORDER BY rn) AS island FROM s),
    runs AS (SELECT o_custkey, sign, island, COUNT(*) AS len FROM g GROUP BY o_custkey, sign, island)
    SELECT o_custkey, MAX(CASE WHEN sign = 1 THEN len ELSE 0 END) AS longest_up, MAX(CASE WHEN sign = -1 THEN len ELSE 0 END) AS longest_down FROM runs GROUP BY o_custkey""",
)
C.add("growth_base_sign", _MONTHLY + " SELECT o_custkey, o_orderkey, CASE WHEN p IS NULL THEN 'no_base' WHEN p = 0 THEN 'zero_base' WHEN p < 0 AND v > 0 THEN 'turned_positive' WHEN p > 0 AND v < 0 THEN 'turned_negative' ELSE 'same_sign' END AS base_sign FROM t")
C.add(
    "proportion_growth",
    _MONTHLY + """ SELECT o_custkey, o_orderkey, CAST(ROUND(CAST(v - 0.005 AS DOUBLE) / CAST(p + 0.005 AS DOUBLE) * 100 - 100, 3) AS DECIMAL(18,3)) AS lo_pct,
    CAST(ROUND(CAST(v + 0.005 AS DOUBLE) / CAST(p - 0.005 AS DOUBLE) * 100 - 100, 3) AS DECIMAL(18,3)) AS hi_pct FROM t WHERE p > 1""",
)
C.add(
    "claim_calculation",
    """SELECT l_orderkey, l_linenumber, CAST(a + b AS DECIMAL(20,2)) AS added, CAST(a - b AS DECIMAL(20,2)) AS subtracted, CAST(a * b AS DECIMAL(30,4)) AS multiplied,
    CAST(ROUND(CAST(a AS DOUBLE) / CAST(NULLIF(b, 0) AS DOUBLE), 8) AS DECIMAL(22,8)) AS divided FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS a, CAST(l_quantity AS DECIMAL(12,2)) AS b FROM {lineitem}) t""",
)
C.add("perturb_number", "SELECT row_id, value, CAST(CAST(ROUND(CAST(TRIM(value) AS DECIMAL(20,2)) * CAST(1.08 AS DECIMAL(4,2)), 2) AS DECIMAL(22,2)) AS VARCHAR(30)) AS perturbed FROM {facts} WHERE regexp_like(TRIM(value), '^[0-9]{{1,9}}[.][0-9]{{2}}$')")
C.add("perturbable_tokens", "SELECT row_id, value, CASE WHEN regexp_like(value, '^(19|20)[0-9]{{2}}$') THEN 'year' WHEN TRY_CAST(value AS DOUBLE) = 0 THEN 'zero' WHEN regexp_like(value, '^[0-9]+([.][0-9]+)?$') THEN 'perturbable' ELSE 'no_number' END AS kind FROM {facts} WHERE value IS NOT NULL AND NOT regexp_like(value, '[eE]')")
QUERIES, SQL = C.queries, C.sql
