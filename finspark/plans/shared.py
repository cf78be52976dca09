"""One statement for both engines: queries whose SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finspark.session import table


class Catalog:
    """Named queries of one module. Tables stand in braces in the statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, statement: str, duck: str | None = None) -> None:
        """A statement for Spark, and the DuckDB one where the dialects differ in more than function names."""
        tables = sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", statement)))
        self.queries[name] = lambda spark, d: spark.sql(statement, **{t: table(spark, d, t) for t in tables})
        text = duck if duck is not None else statement
        names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
        self.sql[name] = to_duck(text.format(**{t: t for t in names})) if duck is None else text.format(**{t: t for t in names})

    def frame(self, name: str, build: Callable[[SparkSession, str], DataFrame], duck: str | None = None) -> None:
        """A query built with the DataFrame API, with SQL that states the same result, if any can."""
        self.queries[name] = build
        if duck is not None:
            self.sql[name] = duck


_NAMES = {"regexp_like": "regexp_matches", "collect_list": "list", "try_divide": "_div"}


def to_duck(text: str) -> str:
    """Function names as DuckDB has them, and replacement of all matches rather than the first."""
    for a, b in _NAMES.items():
        if a != "try_divide":
            text = re.sub(rf"\b{a}\(", f"{b}(", text)
    return re.sub(r"\brx_replace\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"regexp_replace(\1, 'g')", text)
