"""Windows, chunks, spans and repairs of text that built-in expressions cannot give."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

_WIDE = re.compile(r"[⺀-\U0010ffff]")


def estimated_tokens(text: str) -> int:
    """A wide character is a token, four others are one, with a tenth on top."""
    wide = len(_WIDE.findall(text))
    return -(-(44 * wide + 11 * (len(text) - wide)) // 40)


def token_windows(text: str | None, budget: int) -> list[tuple[int, int]]:
    """Windows [start, end) that cover the text, each within the budget where one character is.

    A window ends at a paragraph end if one lies in its second half, and starts up to a quarter of
    the budget before the end of the last.
    """
    out, at, n = [], 0, len(text or "")
    cost = [11 if not _WIDE.match(c) else 44 for c in text or ""]
    while at < n:
        end, used = at, 0
        while end < n and (end == at or used + cost[end] <= 40 * budget):
            used += cost[end]
            end += 1
        if end < n:
            cut = text.rfind("\n", at + (end - at) // 2, end)
            end = cut + 1 if cut > at else end
        out.append((at, end))
        if end >= n:
            break
        start, back = end, 0
        while start > at + 1 and back + cost[start - 1] <= 10 * budget:
            start -= 1
            back += cost[start]
        at = start if start > at and text[end - 1] != "\n" else end
    return out


def chunk(text: str | None, limit: int = 1800) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at paragraphs, else after the last sentence mark in the last two thirds."""
    out, rest = [], ""
    for paragraph in re.split(r"\n\s*\n", text or ""):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if rest and len(rest) + len(paragraph) + 2 <= limit:
            rest += "\n\n" + paragraph
            continue
        if rest:
            out.append(rest)
        rest = paragraph
        while len(rest) > limit:
            at = max(rest.rfind(c, limit // 3, limit) for c in "。.!?！？") + 1 or limit
            out.append(rest[:at])
            rest = rest[at:].lstrip()
    return [*out, rest] if rest else out


@udtf(returnType=T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("text", T.StringType())]))
class RegexSpans:
    """Matches of a pattern with code-point offsets, usable with LATERAL."""

    def eval(self, text: str, pattern: str):
        for m in re.finditer(pattern, text or ""):
            yield m.start(), m.end(), m.group()


def explode_windows(texts: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """key, span_start, span_end: one row per window; null and empty texts give none."""
    kind = dict(texts.dtypes)[key]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, s, e) for k, t in zip(b[key], b[text]) for s, e in token_windows(t, budget)], columns=[key, "span_start", "span_end"])

    return texts.select(key, text).mapInPandas(one, f"{key} {kind}, span_start int, span_end int")


def explode_chunks(texts: DataFrame, key: str, text: str, limit: int = 1800) -> DataFrame:
    """key, chunk_no, chunk: one row per chunk."""
    kind = dict(texts.dtypes)[key]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(chunk(t, limit))], columns=[key, "chunk_no", "chunk"])

    return texts.select(key, text).mapInPandas(one, f"{key} {kind}, chunk_no int, chunk string")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks; null for two empty texts, 0 for one."""

    def one(x: str | None, y: str | None) -> float | None:
        x, y = x or "", y or ""
        return None if not x and not y else round(SequenceMatcher(None, x, y).ratio(), 6) if x and y else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def recovered_json(s: pd.Series) -> pd.Series:
    """The JSON value of a reply: fences taken off, at most one closing brace added; null where none parses."""

    def one(t: str | None) -> str | None:
        body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", t or "")
        for candidate in (body, body + "}"):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
            except (ValueError, RecursionError):
                continue
        return None

    return s.map(one)


def edit_spans(a: str, b: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) that turn a into b."""
    return [(i, j, b[k:m]) for tag, i, j, k, m in SequenceMatcher(None, a, b, False).get_opcodes() if tag != "equal"]


def greedy_cover(rows: DataFrame, item: str, key: str, budget: int) -> list[tuple]:
    """Items picked one by one, each covering the most keys not yet covered, ties to the smallest, at most ``budget``.

    Sequential by nature: every pick is one aggregation over what is left; only the pick reaches the driver.
    """
    left, out = rows.select(item, key).dropna().distinct(), []
    for _ in range(budget):
        top = left.groupBy(item).count().orderBy(F.desc("count"), item).limit(1).collect()
        if not top:
            break
        out.append((top[0][0], top[0]["count"]))
        covered = left.where(F.col(item) == top[0][0]).select(key)
        left = left.join(covered, key, "left_anti")
    return out


def garbled(text: Column) -> Column:
    """Share of characters that decoding lost."""
    return F.length(F.regexp_replace(text, "[^�-]", "")) / F.greatest(F.length(text), F.lit(1))
