"""Texts that were cut off by a field limit or in transfer.

Per field and source the lengths are tested for spikes: lengths, in characters or in bytes, that far
more texts have than their neighbours, at the end of the distribution. A text at such a length is
taken as cut unless its end is complete. Texts at other lengths are taken as cut only where their
own end shows it. What counts as complete is a sentence mark, a closed JSON value, or a closing line
that recurs over the corpus (result lines, list items, table rows).

Definitions for odd input: null, empty and blank texts, bare words and placeholders are not cut; a
text that trails off on purpose after a whole statement is not cut; an invalid but closed JSON value
is not cut; marks appended after a cut ("...", a replacement character, "(cont", closing brackets)
do not hide it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A length is a spike from this many texts on, where it has SPIKE_RATIO times the mean of the lengths within REACH,
#: at lengths from LEAST on. Closing lines recur in this share of all texts, JSON keys in that share of the objects of one path.
SPIKE_COUNT, SPIKE_RATIO, REACH, LEAST = 4, 6.0, 25, 64
RECURS, RECURS_COUNT, KEY_SHARE = 0.001, 3, 0.9

_END = "。.!?！？｡；;"
_CLOSERS = "”’\"'）)】]》」』"
_MARKER = re.compile(
    r"[\s]*(?:[\[(（<【]\s*(?:cont|output limit|truncat|limit|未完|截断|已截断|more)[^\])）>】\n]{0,24}[\])）>】]?|<\|?\w{0,12}\|?>)\s*$", re.I
)
_DOTS = re.compile(r"(?:…+|\.{2,}|。{2,})\s*$")
_PURPOSE = re.compile(r"(?:and so on|and so forth|etc|and more|其余从略|余略|下略|从略|以此类推|等等)$", re.I)
_JSON = re.compile(r"^\s*(?:[^\n{\[]{0,16}|\[\w{1,12}\]\s*)?(?:```(?:json)?\s*)?(?=\{\s*[\"}]|\[\s*[{\"\]])", re.I)
_LINE = re.compile(r"^(?:[-*•]\s+\S.*|\|.*\||\[\d+\]\s*\S.*|\d+[).、]\s*\S.*|[\w一-鿿 ]{1,16}\s*[:：=]\s*\S.{0,24})$")


@dataclass
class Known:
    """What the corpus shows: spikes by (field, source, kind), recurring ends, and the keys of JSON objects by path."""

    spikes: dict = field(default_factory=dict)
    closings: set = field(default_factory=set)
    keys: dict = field(default_factory=dict)


def _last_line(text: str) -> str:
    return text.rstrip().rsplit("\n", 1)[-1].strip()


def _trail(text: str) -> str:
    """The words after the last whole sentence, without the dots they trail off with."""
    body = _DOTS.sub("", text.rstrip())
    cut = max((body.rfind(c) for c in "。.!?！？\n"), default=-1)
    return body[cut + 1 :].strip()


def json_start(text: str) -> int:
    """Where a JSON value starts, or -1 for prose."""
    m = _JSON.match(text)
    return m.end() if m and m.end() < len(text) else -1


def scan(body: str) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    """State of a JSON text that no strict parser takes, and the keys of each closed object with its path.

    open: ends within a string, value or container; broken: a key has no value, or brackets close what was
    never opened; closed: all values closed (a comma may be left over).
    """
    stack: list[list] = []  # [bracket, name, keys, key waiting for a value]
    closed: list[tuple[str, tuple[str, ...]]] = []
    name, i, broken, n = "$", 0, False, len(body)
    last = ""
    while i < n:
        c = body[i]
        if c == '"':
            j = i + 1
            while j < n and body[j] != '"':
                j += 2 if body[j] == "\\" else 1
            if j >= n:
                return "open", closed
            k = j + 1
            while k < n and body[k].isspace():
                k += 1
            if stack and stack[-1][0] == "{" and stack[-1][3] is None:
                if k < n and body[k] == ":":
                    stack[-1][2].append(body[i + 1 : j])
                    stack[-1][3] = body[i + 1 : j]
                    i = k + 1
                    last = ":"
                    continue
                broken = broken or k < n
            elif stack and stack[-1][0] == "{":
                stack[-1][3] = None
            i, last = j + 1, '"'
            continue
        if c in "{[":
            path = name if not stack else f"{stack[-1][1]}.{stack[-1][3] or ''}" if stack[-1][0] == "{" else f"{stack[-1][1]}[]"
            stack.append([c, path if len(stack) < 5 else "", [], None])
        elif c in "}]":
            if not stack or (stack[-1][0] == "{") != (c == "}"):
                return "broken", closed
            b, path, keys, waiting = stack.pop()
            if b == "{":
                closed.append((path, tuple(keys)))
                broken = broken or (waiting is not None and last == ":")
            if stack and stack[-1][0] == "{":
                stack[-1][3] = None
            if not stack:
                rest = body[i + 1 :].strip().strip("`").strip()
                return ("broken" if broken or (rest and rest[0] in "]}") else "closed"), closed
        elif c == "," and stack and stack[-1][0] == "{":
            broken = broken or last == ":"
            stack[-1][3] = None
        if not c.isspace():
            last = c
        i += 1
    return "open", closed


def _objects(value, path: str = "$", depth: int = 0) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Keys of each object of a parsed value, innermost first, in order."""
    if depth > 4:
        return
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _objects(v, f"{path}.{k}", depth + 1)
        yield path, tuple(value)
    elif isinstance(value, list):
        for v in value:
            yield from _objects(v, f"{path}[]", depth + 1)


def _parse(body: str) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    try:
        value, end = json.JSONDecoder().raw_decode(body)
    except (ValueError, RecursionError):
        return scan(body)
    rest = body[end:].strip().strip("`").strip()
    return ("broken" if rest[:1] in ("]", "}") else "closed"), list(_objects(value))


def is_cut(text: str | None, at_spike: bool, known: Known) -> bool:
    """Whether one text was cut. at_spike: it has a length at which its source's lengths pile up."""
    if text is None or not text.strip():
        return False
    raw = text.rstrip()
    replaced = raw.endswith("�")
    body = _MARKER.sub("", raw.rstrip("�")).rstrip()
    if not body:
        return False
    start = json_start(body)
    if start >= 0:
        state, objects = _parse(body[start:])
        if state != "closed":
            return True
        usual = [known.keys.get(p, frozenset()) - set(k) for p, k in objects[-2:]]
        return any(usual)
    if replaced:
        return True
    last = _last_line(body)
    if last in known.closings or body.strip() in known.closings:
        return False
    dotted = _DOTS.search(body)
    if dotted:
        trail, body = _trail(body), body[: dotted.start()].rstrip()
        if not body or body[-1] in _END or _PURPOSE.search(body) or trail in known.closings:
            return False
        return True
    tail = body.rstrip(_CLOSERS)
    if tail and tail[-1] in _END:
        if tail[-1] == "." and re.search(r"(?<![\w.])[^\s\w]{0,2}[\d,]*\d\.$", tail) and not re.search(r"(?<!\d)(?:19|20)\d\d\.$", tail):
            return True  # within a decimal number
        return False
    if "\n" in body and any(c.startswith(last) for c in known.closings if len(c) > len(last) > 3):
        return True
    if not re.search(rf"[{re.escape(_END)}，,、]", body) and len(body) <= 12 and not at_spike:
        return False  # a bare word
    if _LINE.match(last) and not at_spike:
        return False
    return True


def stack_texts(model_responses: DataFrame, run_results: DataFrame) -> DataFrame:
    """field_name, record_id, source, text of both tables."""
    return model_responses.select(
        F.lit("model_responses.content").alias("field_name"), F.col("response_key").alias("record_id"), "source", F.col("content").alias("text")
    ).unionAll(
        run_results.select(F.lit("run_results.last_message").alias("field_name"), F.col("request_id").alias("record_id"), "source", F.col("last_message").alias("text"))
    )


def length_spikes(texts: DataFrame) -> DataFrame:
    """field_name, source, kind (chars or bytes), length, n: lengths at which texts pile up at the end of the histogram.

    One shuffle of pre-aggregated counts.
    """
    t = texts.where(F.col("text").isNotNull() & (F.length("text") > 0))
    kinds = F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("kind"), F.octet_length("text").alias("length"))))
    hist = t.select("field_name", "source", kinds.alias("k")).groupBy("field_name", "source", "k.kind", "k.length").agg(F.count("*").alias("n"))
    key = Window.partitionBy("field_name", "source", "kind")
    near = key.orderBy("length").rangeBetween(-REACH, REACH)
    after = key.orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    scored = hist.withColumn("near", (F.sum("n").over(near) - F.col("n")) / (2.0 * REACH)).withColumn("above", F.coalesce(F.sum("n").over(after), F.lit(0))).withColumn("all", F.sum("n").over(key))
    return scored.where(
        (F.col("length") >= LEAST)
        & (F.col("n") >= SPIKE_COUNT)
        & (F.col("n") >= SPIKE_RATIO * F.greatest(F.col("near"), F.lit(0.5)))
        & ((F.col("above") <= 0.5 * F.col("n")) | (F.col("n") >= 0.01 * F.col("all")))
    ).select("field_name", "source", "kind", "length", "n")


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: Counter = Counter()
    for b in batches:
        for t in b["text"]:
            count["texts", "", ""] += 1
            if t is None or not t.strip():
                continue
            start = json_start(t)
            if start < 0:
                last = _last_line(t)
                if len(last) <= 64 and ("\n" in t or len(t) <= 64):
                    count["closing", last, ""] += 1
                if _DOTS.search(t) and 0 < len(_trail(t)) <= 32:
                    count["closing", _trail(t), ""] += 1
                continue
            for path, keys in _parse(t[start:])[1]:
                count["object", path[:64], ""] += 1
                for k in set(keys):
                    count["key", path[:64], k[:64]] += 1
    yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["what", "a", "b", "n"])


def learn(texts: DataFrame) -> Known:
    """What the corpus shows, from two aggregations. Only what recurs in a fixed share of the texts reaches the driver."""
    known = Known()
    for r in length_spikes(texts).collect():  # at most 100 lengths hold a hundredth of a source, one ends each histogram
        known.spikes.setdefault((r.field_name, r.source, r.kind), set()).add(r.length)
    counts = texts.select("text").mapInPandas(_profile, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= RECURS_COUNT)
    texts_n = max([r.n for r in often.where("what = 'texts'").collect()], default=0)
    rows = often.where(F.col("n") >= RECURS * texts_n).where("what <> 'texts'").collect()
    objects = {r.a: r.n for r in rows if r.what == "object"}
    known.closings = {r.a for r in rows if r.what == "closing"}
    for r in rows:
        if r.what == "key" and r.a in objects and r.n >= KEY_SHARE * objects[r.a]:
            known.keys[r.a] = known.keys.get(r.a, frozenset()) | {r.b}
    return known


def mark_cut(texts: DataFrame, known: Known | None = None) -> DataFrame:
    """field_name, record_id, source, cut: one row per text; the flags come from one pass without a shuffle."""
    known = learn(texts) if known is None else known

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flags = []
            for f, s, t in zip(b["field_name"], b["source"], b["text"]):
                s = None if s is None or s != s else s
                spike = t is not None and (
                    len(t) in known.spikes.get((f, s, "chars"), ()) or len(t.encode("utf-8", "replace")) in known.spikes.get((f, s, "bytes"), ())
                )
                flags.append(is_cut(t, spike, known))
            yield b[["field_name", "record_id", "source"]].assign(cut=flags)

    return texts.mapInPandas(mark, "field_name string, record_id string, source string, cut boolean")


def cut_records(model_responses: DataFrame, run_results: DataFrame) -> DataFrame:
    """field_name, record_id of the texts that were cut."""
    return mark_cut(stack_texts(model_responses, run_results)).where("cut").select("field_name", "record_id")


def cut_share(model_responses: DataFrame, run_results: DataFrame) -> DataFrame:
    """field_name, source, records, cut, share: how often each source truncates, over all of its records."""
    marked = mark_cut(stack_texts(model_responses, run_results))
    return marked.groupBy("field_name", "source").agg(
        F.count("*").alias("records"), F.sum(F.col("cut").cast("long")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share")
    )
