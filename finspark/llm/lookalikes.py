"""One consistent form for text that looks the same but differs in its characters.

Look-alike classes are the closure, by union-find, of pairs of strings that render alike: full and
half width, presentation forms and compatibility ideographs (from the Unicode character database),
composed and combining accents, kinds of blank, kinds of hyphen, letters of other scripts with the
same shape, and characters that show nothing, which pair with the empty string. Each class is
represented by the member that is most frequent in the corpus. Texts are rewritten greedily,
longest match first, by an automaton over all members, until nothing changes.

Digits, words, letter case and accents that are missing keep their difference: superscripts, circled
numbers and other compatibility forms that read differently are no look-alikes.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter.
SAME_SHAPE = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY Һh ԌG "
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϳj ϲc "
    "օo ɡg ɑa ‐- ‑- −- ﹣- ⁃- "
    "⻓长 ⻔门 ⻜飞 ⻢马 ⻉贝 ⻋车 ⻅见 ⻆角 ⻛风 ⻝食 ⻘青 ⻥鱼 ⻦鸟 ⻰龙 ⻩黄 ⻬齐 ⻮齿 ⻣骨 ⻤鬼 ⺠民 ⻄西 ⻁虎 ⻚页 ⻙韦 ⻨麦 ⻐钅 ⺌小"
).split()
#: Kinds of compatibility decomposition that keep the look of the text.
_LOOKS_ALIKE = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<vertical>", "<isolated>", "<final>", "<initial>", "<medial>"}


class UnionFind:
    """Classes of strings under union."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _pairs(chars: set[str]) -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, over the characters that occur."""
    for a, b in SAME_SHAPE:
        yield a, b
    for c in chars:
        kind = unicodedata.category(c)
        if kind == "Zs":
            yield c, " "
            continue
        if kind == "Cf" or c in "͏ᅟᅠㅤ":
            yield c, ""
            continue
        spec = unicodedata.decomposition(c)
        if not spec:
            continue
        tag = spec.split()[0]
        whole = unicodedata.normalize("NFKC", c)
        if tag[0] != "<":  # canonical: composed letters, compatibility ideographs
            one = unicodedata.normalize("NFC", c)
            if one != c:
                yield c, one
            apart = unicodedata.normalize("NFD", c)
            if len(apart) > 1:
                yield c, apart
        elif tag in _LOOKS_ALIKE and whole != c and whole.strip():
            yield c, whole
            if len(whole) == 1 and unicodedata.category(whole) == "Zs":
                yield c, " "


def build_rules(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for every member that is rewritten.

    counts: occurrences of each character of the corpus. The representative of a class is its most
    frequent member, a member of several characters counting as its rarest one; ties go to the
    shorter, then the lower code point. The class of the empty string is always represented by it.
    """
    chars = set(counts)
    marks = [c for c in chars if unicodedata.combining(c)]
    uf = UnionFind()
    for a, b in _pairs(chars | set("".join(SAME_SHAPE))):
        uf.union(a, b)

    def seen(x: str) -> int:
        return min((counts.get(c, 0) for c in x), default=sys.maxsize)

    def rules_of() -> dict[str, str]:
        out = {}
        for members in uf.classes():
            best = "" if "" in members else min(members, key=lambda m: (-seen(m), len(m), m))
            out |= {m: best for m in members if m != best}
        return out

    rules = rules_of()
    # a combining mark after any look-alike of its base: the string joins the class of the composed letter
    bases = [c for c in chars if not unicodedata.combining(c) and unicodedata.category(c)[0] == "L"]
    for m in marks:
        for c in bases:
            one = unicodedata.normalize("NFC", rules.get(c, c) + m)
            if len(one) == 1:
                uf.union(c + m, one)
    return rules_of()


class Rewriter:
    """Greedy rewriting by an Aho-Corasick automaton, longest match first."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.single = str.maketrans({k: v for k, v in rules.items() if len(k) == 1})
        self.several = {k: v for k, v in rules.items() if len(k) > 1}
        self.rules, self._auto = rules, None

    def __getstate__(self) -> dict:
        return {"rules": self.rules}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["rules"])

    def _automaton(self) -> ahocorasick.Automaton:
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for k, v in self.rules.items():
                self._auto.add_word(k, (len(k), v))
            self._auto.make_automaton()
        return self._auto

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (n, to) in self._automaton().iter_long(text):
            out.append(text[at : end - n + 1])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if not self.rules:
            return text
        for _ in range(4):  # dropping what shows nothing can join a base and its mark
            new = self._once(text)
            if new == text:
                break
            text = new
        return text


def character_counts(*texts: DataFrame) -> dict[str, int]:
    """Occurrences of each character over all rows of one-column frames.

    Counted per partition, then summed; what reaches the driver is one row per distinct code point,
    which Unicode bounds.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for t in b.iloc[:, 0].dropna():
                total.update(t)
        yield pd.DataFrame({"c": [ord(c) for c in total], "n": list(total.values())})

    parts = None
    for t in texts:
        one = t.mapInPandas(count, "c int, n long")
        parts = one if parts is None else parts.unionAll(one)
    return {chr(r.c): r.n for r in parts.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def fit(*texts: DataFrame) -> Rewriter:
    """The rewriter for the corpus that the frames hold."""
    return Rewriter(build_rules(character_counts(*texts)))


def consistent(rewriter: Rewriter, text: Column) -> Column:
    """The text in its one form; null stays null, blank and empty texts keep what shows of them."""

    @F.pandas_udf("string")
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(rewriter, na_action="ignore")

    return rewrite(text)


def gold_spans(cases: DataFrame) -> DataFrame:
    """case_id, document_id, span_index, span_start, span_end, text: one row per span of ``gold``."""
    return cases.where(F.col("gold").isNotNull()).select(
        "case_id", "document_id", F.posexplode("gold.spans").alias("span_index", "span")
    ).select("case_id", "document_id", "span_index", "span.span_start", "span.span_end", "span.text")


def spans_alike(cases: DataFrame, inputs: DataFrame) -> DataFrame:
    """case_id, span_index of gold spans that differ from the content they quote yet look the same.

    Null texts, offsets or contents and offsets that are no range give no case. A document that was
    delivered several times is compared with each distinct delivery. Joined by document_id; only
    the quoted slice, not the content, reaches Python.
    """
    rewriter = fit(gold_spans(cases).select("text"), inputs.select("content"))
    spans = gold_spans(cases).where("text is not null and span_start >= 0 and span_end >= span_start")
    docs = inputs.select("document_id", "content").where("document_id is not null and content is not null")
    quoted = spans.join(docs, "document_id").select(
        "case_id", "span_index", "text", F.col("content").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("quoted")
    )
    differ = quoted.where("text <> quoted").distinct()
    alike = differ.where(consistent(rewriter, F.col("text")) == consistent(rewriter, F.col("quoted")))
    return alike.select("case_id", "span_index").distinct()


def consistent_contents(cases: DataFrame, inputs: DataFrame) -> DataFrame:
    """document_id, content in one form, for every row of inputs."""
    rewriter = fit(gold_spans(cases).select("text"), inputs.select("content"))
    return inputs.select("document_id", consistent(rewriter, F.col("content")).alias("content"))
