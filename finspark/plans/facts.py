"""Queries over facts in common units."""

from __future__ import annotations

from finspark.operators import units
from finspark.session import table

QUERIES = {
    "p1_found": lambda spark, d: units.same_quantity_pairs(table(spark, d, "facts")),
    "p1_common": lambda spark, d: units.common_quantities(table(spark, d, "facts")),
}
SQL: dict[str, str] = {}
