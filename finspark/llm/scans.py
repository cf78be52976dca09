"""Text of scanned pages, repaired into continuous paragraphs, with the place of every defect.

Three defects are told apart, each by how often a form recurs. Furniture: lines at the edge of a page whose
form, digits masked and confusable glyphs folded, recurs at that edge over the pages of the document or over the
corpus but hardly inside pages; a number at the edge is furniture where it counts with the pages. Split words:
lines whose end is a word part before a break mark, where the corpus knows the joined word rather than the
compound. Misread characters: characters and words are grouped by their confusable-glyph skeleton, letters within
numbers by the class of the digits; in one context the frequent form of a group is right and the rare ones are
misread.

Lines are grouped by page once and written; a page is one row from then on. Characters are counted as packed
triples (left, form, right), words as pairs of neighbours, both summed up before any shuffle. Which triples and
pairs are misread is decided on these counts, and the places of the lines meet the decisions in a join, broadcast by
Spark where the decisions are few and shuffled where they are not.

Odd input: null and blank texts have no defect; null boxes are not used at all; null document, page or order only
lose the line its neighbours; repeated lines are each judged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finspark.llm import folding
from finspark.session import cut, map_batches

# Pairs of characters that scanners take for each other.
CJK_PAIRS = (
    "菅营 人入 闰润 同司 同周 木本 未末 午年 午牛 坏环 巿市 塲场 方万 无元 无天 庹度 责贡 责贵 钱线 王主 王玉 贷货 争净 瑞端 忆亿 锁销 "
    "顶项 土士 己已 巳已 日曰 千干 千于 大太 大犬 夭天 未来 刀力 儿几 贝见 兔免 侯候 折拆 拔拨 科料 祟崇 戊戌 戍戌 "
    "薄簿 暑署 幕墓 慕幕 赢嬴 辨辩 洽治 徒徙 崖涯 没设 伸仲 住往 侍待 侍持 持待 抢抡 仓仑 今令 含台 困因 囚因 "
    "白自 目自 且旦 旧归 早旱 杳查 析折 枝技 析拆 极板 观现 规现 计汁 让计 股般 收牧 增憎 比此 北比 末来 间问 向问 门们 "
    "与写 业亚 仅权 付村 体休 估佑 使便 倒例 偿尝 写与 冶治 准淮 减咸 则刖 利刊 别剐 到致 制刷 前煎 加如 动勤 勿匆"
).split()
# Letters that scanners put for digits.
_ALSO_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "Z": "2", "|": "1", "B": "8"}

#: How often the right form must stand in one context for each time the other does, and at least. The first is for
#: contexts of both sides or of a neighbouring word, the second for those of one side or of none.
DOMINATES, DOMINATES_ALONE, AT_LEAST = 5, 12, 3
#: Lines counted as the edge of a page; share of a form's occurrences that must lie there; documents a form must recur in.
EDGE, EDGE_SHARE, EDGE_DOCS = 2, 0.85, 3
#: Order of lines that name none: before all others.
NO_ORDER = -(1 << 63)


def _glyph_classes() -> dict[str, str]:
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in CJK_PAIRS:
        ra, rb = find(a), find(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return {c: find(c) for c in up}


GLYPH = _glyph_classes()
_LETTERS = str.maketrans({"0": "o", "1": "l", "|": "l", "c": "e", "q": "g", "9": "g", "5": "s", "2": "z", "8": "b", "6": "b"})
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9|]+")
_WORD_OR_LINE = re.compile(r"[0-9|]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9|\x01]*|\n")
_BROKEN = re.compile(r"([A-Za-zÀ-ɏ0-9|]+)\s*[-‐‑¬\u00ad][^\S\n]*\n\s*([A-Za-zÀ-ɏ0-9|]+)")
_BREAK_MARKS = "-‐‑¬­"
_NUMBERISH = re.compile(r"(?<![A-Za-zÀ-ɏ])[0-9OoIlSZB|][0-9OoIlSZB|.,]*(?![A-Za-zÀ-ɏ])")
_MIXED = re.compile(r"\d[.,]?[OoIlSZB|]|[OoIlSZB|][.,]?\d")
_BARRED = re.compile(r"[|Il]?\d+[|]\d+|\d+[|].*")


def word_skeleton(word: str) -> str:
    """Words that scanners take for each other have one skeleton."""
    w = word[:1].lower() + word[1:].replace("I", "l").lower()
    w = w.translate(_LETTERS).replace("m", "rn").replace("w", "vv").replace("h", "li").replace("ti", "li")
    return w


def broken_end(text: str) -> tuple[str, int, str] | None:
    """(word part, its end, mark) where a line ends in a word part and a break mark."""
    t = text.rstrip()
    if len(t) < 2 or t[-1] not in _BREAK_MARKS:
        return None
    end = at = len(t[:-1].rstrip())
    while at and _WORD.match(t[at - 1]):
        at -= 1
    return (t[at:end], end, t[-1]) if at < end else None


def _tokens(text: str, prev: str | None, nxt: str | None) -> list[tuple[int, int, str]]:
    """(start, end, word) of each word; a word that is broken over lines is whole, its place cut to this line."""
    out = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text) if any(c.isalpha() for c in m.group())]
    m = broken_end(text)
    if m and nxt and out and out[-1][1] == m[1]:
        n = _WORD.match(nxt.lstrip())
        if n:
            out[-1] = (*out[-1][:2], out[-1][2] + "\x01" + n.group())
    p = broken_end(prev) if prev else None
    if p and out and not text[: out[0][0]].strip():
        out[0] = (*out[0][:2], p[0] + "\x02" + out[0][2])
    return out


def _plain_word(w: str) -> str:
    return w.replace("\x01", "").replace("\x02", "")


def scanned_lines(ocr_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """All scanned lines with text: field, key, sub (line of a block), doc (document and run), page, ord, text, place (doc_id, run_id and page as given)."""
    a = ocr_lines.select(
        F.lit("o").alias("field"), F.col("line_key").alias("key"), F.lit(0).alias("sub"), "doc_id", "run_id", "page",
        F.coalesce(F.col("line_no").cast("long"), F.lit(NO_ORDER)).alias("ord"), "text",
    )
    b = blocks.where(F.col("level") == "ocr").select(
        F.lit("b").alias("field"), F.col("block_key").alias("key"), "doc_id", "run_id", "page", F.coalesce(F.col("block_order").cast("long"), F.lit(NO_ORDER)).alias("ord"),
        F.posexplode(F.split(F.col("text"), r"\r?\n")).alias("sub", "text"),
    )
    both = a.unionAll(b.select("field", "key", "sub", "doc_id", "run_id", "page", "ord", "text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    lost = F.col("doc_id").isNull() | F.col("page").isNull()
    doc = F.xxhash64("field", F.when(lost, F.concat(F.lit("\x00"), F.col("key").cast("string"))).otherwise(F.col("doc_id")), F.coalesce("run_id", F.lit("")))
    return both.select("field", "key", "sub", doc.alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), "ord", "text", F.struct("doc_id", "run_id", "page").alias("place"))


def pages_of(lines: DataFrame) -> DataFrame:
    """One row per page: pid, doc, page, place, x (its lines in order: ord, key, sub, field, text)."""
    p = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "sub", "field", "text"))).alias("x"), F.min("place").alias("place"))
    return cut(p.select(F.monotonically_increasing_id().alias("pid"), "doc", "page", "place", "x"), "pages")


# ---- furniture


def furniture_form(text: Column) -> Column:
    """The line as furniture recurs: glyphs and words folded to skeletons, digits masked, blanks squeezed, a trailing number dropped."""
    t = F.translate(F.regexp_replace(F.trim(text), r"\s+", " "), "".join(GLYPH), "".join(GLYPH.values()))
    t = F.regexp_replace(t, r"(?<![A-Za-z])[OolIS]*[0-9][0-9OolIS]*(?![A-Za-z])", "#")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[A-Za-z])I", "l"), r"(?<=[A-Za-z])[|](?=[A-Za-z])", "l")
    t = F.translate(F.lower(t), "019256" + "8cq", "olgzsb" + "beg")
    for a, b in (("m", "rn"), ("w", "vv"), ("h", "li"), ("ti", "li")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, r"[0-9]+", "#"), r"(?<=\S) +#$", "")


_HAN = "[一-鿿]"


def furniture_piece(form: Column) -> Column:
    """The part of a running head that does not name the company or the year: before or after a bar, from the year on, or the last words."""
    han, bars = form.rlike(_HAN), F.filter(F.split(form, r"\s*[｜|·•]\s*"), lambda p: p != "")
    parts = F.filter(F.split(form, r"\s*[｜|·•/]\s*|\s+"), lambda p: p != "")
    words = F.split(form, " ")
    year, last = F.substring_index(form, "#", 1), F.element_at(parts, -1)
    from_year = F.substring(form, F.length(year) + 1, F.length(form))
    return (
        F.when(han & form.contains("#"), F.when(F.length(from_year) >= 5, from_year).otherwise(""))
        .when(F.size(bars) > 1, F.concat(F.lit("|"), F.when(han, bars[0]).otherwise(F.element_at(bars, -1))))
        .when(han, F.when((F.size(parts) > 1) & (F.length(last) >= 4), last).otherwise(""))
        .when(F.size(words).between(3, 6), F.array_join(F.slice(words, -3, 3), " "))
        .otherwise("")
    )


def _roman() -> Column:
    """Numbers 1 to 89 in small Roman letters."""
    tens, ones = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    pairs = [(t + o, 10 * i + j) for i, t in enumerate(tens) for j, o in enumerate(ones) if t + o not in ("", "l")]
    return F.create_map(*[F.lit(v) for p in pairs for v in p])


def page_value(text: Column) -> Column:
    """The first number of a line that has at most two numbers and few other signs, or the Roman number it is, or null."""
    t = F.regexp_replace(F.trim(text), r"^[\s\-~—–·]+|[\s\-~—–·]+$", "")
    number = r"(?<![A-Za-z0-9])[OolIS|B]*[0-9][0-9OolISZB]*(?![A-Za-z0-9])"
    found = F.regexp_extract_all(t, F.lit(number), F.lit(0))
    digits = F.translate(found[0], "".join(_ALSO_DIGITS), "".join(_ALSO_DIGITS.values()))
    short = (F.length(t) <= 24) & F.size(found).between(1, 2) & (F.length(digits) <= 4)
    return F.when(short, digits.try_cast("int")).when(t.rlike("^[ivxl]{1,7}$"), _roman()[t])


def _edge(i: Column, n: Column) -> Column:
    return (i < EDGE) | (i >= n - EDGE)


def mark_furniture(pages: DataFrame) -> DataFrame:
    """pid, m: places of the furniture lines of each page that has any. Counts are summed up before each shuffle."""
    n = F.col("n")
    slim = pages.select("pid", "doc", "page", F.size("x").alias("n"), "x.text")
    every = slim.select(F.posexplode("text").alias("i", "t"), "n").select(furniture_form(F.col("t")).alias("form"), _edge(F.col("i"), n).alias("edge"))
    every = every.select(F.xxhash64("form").alias("form"), F.when(F.col("form") != "", F.xxhash64(F.lit(1), furniture_piece(F.col("form")))).alias("piece"), "edge")
    nothing = F.xxhash64(F.lit(1), F.lit(""))
    e = slim.select("pid", "doc", "page", "n", F.posexplode("text").alias("i", "t")).where(_edge(F.col("i"), n))
    e = e.withColumn("f", furniture_form(F.col("t"))).withColumn("piece", F.xxhash64(F.lit(1), furniture_piece(F.col("f")))).withColumn("form", F.xxhash64("f"))
    side = F.when(F.col("i") < EDGE, "t").otherwise("b")
    e = cut(e.select("pid", "doc", "page", "i", "t", "f", "form", "piece", side.alias("side"), (page_value(F.col("t")) - F.col("page")).alias("step")), "edges")

    # occurrences of forms and pieces anywhere; only those that stand at an edge matter
    anywhere = every.select(F.explode(F.array("form", "piece")).alias("k"), "edge").groupBy("k").agg(F.count("*").alias("all"), F.sum(F.col("edge").cast("int")).alias("at_edge"))
    places = e.select("doc", "page", F.explode(F.array("form", "piece")).alias("k")).where(F.col("k") != nothing)
    per_doc = places.groupBy("k", "doc").agg(F.countDistinct("page").alias("pages"))
    docs = per_doc.groupBy("k").agg(F.count("*").alias("docs"))
    good = docs.join(anywhere.where("at_edge > 0"), "k").where(F.col("at_edge") >= EDGE_SHARE * F.col("all"))
    recurs = good.select("k", "docs", (F.col("at_edge") >= 0.95 * F.col("all")).alias("always"))
    steps = e.where("step is not null").groupBy("doc", "side", "form", "step").agg(F.countDistinct("page").alias("counted"))
    doc_pages = pages.groupBy("doc").agg(F.countDistinct("page").alias("doc_pages"))
    judged = (
        e.join(recurs.select(F.col("k").alias("form"), "docs"), "form", "left")
        .join(recurs.where(F.col("always") & (F.col("docs") >= 2 * EDGE_DOCS)).select(F.col("k").alias("piece"), F.lit(True).alias("part")), "piece", "left")
        .join(per_doc.select(F.col("k").alias("form"), "doc", "pages"), ["form", "doc"], "left")
        .join(steps, ["doc", "side", "form", "step"], "left")
        .join(doc_pages, "doc")
    )
    heading = F.col("t").rlike(r"^\s*(?:[一二三四五六七八九十]+、|\d+\.\s|[（(][一二三四五六七八九十\d]+[)）])")
    figures = F.col("f").rlike(r"^[#\s.,%％+()（）-]*$")
    sentence = (F.length("t") > 60) | F.col("t").rlike(r"[。.!?！？，,；;]\s*$")
    recurring = (F.col("docs") >= EDGE_DOCS) | (F.col("pages") >= F.greatest(F.lit(2), 0.4 * F.col("doc_pages")))
    furniture = (F.col("counted") >= 2) | (~figures & ~heading & ~sentence & ((F.col("docs").isNotNull() & recurring) | F.col("part")))
    return cut(judged.where(F.coalesce(furniture, F.lit(False))).groupBy("pid").agg(F.collect_set("i").alias("m")), "furniture")


# ---- misread characters and words: what is counted

_GLYPHS = np.zeros(0x110000, dtype=bool)
_MASK = np.arange(0x110000, dtype=np.uint32)
for _c, _to in GLYPH.items():
    _GLYPHS[ord(_c)], _MASK[ord(_c)] = True, ord(_to)
_DIGITS = np.zeros(0x110000, dtype=bool)
_DIGITS[0x30:0x3A] = True
_MASK[0x30:0x3A] = ord("#")
_SHIFT = np.uint64(21)


def _letters_in_numbers(text: str) -> list[int]:
    """Places of letters within numbers."""
    if not _MIXED.search(text):
        return []
    out = []
    for m in _NUMBERISH.finditer(text):
        t = m.group()
        if any(c.isdigit() for c in t) and any(c in _ALSO_DIGITS for c in t) and not _BARRED.fullmatch(t):
            out += [m.start() + k for k, c in enumerate(t) if c in _ALSO_DIGITS]
    return out


def _triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, packed triples) of the characters of a text that could be misread; the text starts and ends with a line feed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    masked, form, wanted = _MASK[codes], codes.astype(np.uint64), _GLYPHS[codes]
    digit = _DIGITS[codes]
    form[digit] = ord("#")
    at = _letters_in_numbers(text)
    if at:
        masked[at] = ord("#")
    wanted |= digit
    wanted[at] = True
    places = np.flatnonzero(wanted)
    wide = masked.astype(np.uint64)
    return places, (wide[places - 1] << (_SHIFT + _SHIFT)) | (form[places] << _SHIFT) | wide[places + 1]


def _stream(lines: list[str]) -> tuple[str, list[int]]:
    """The lines of a page as one text for triples, and where each starts in it.

    A character at a line's end has the next line's first one beside it, a blank between where a Western word is
    there, or a line feed where one of the two lines is a short one at the page's edge, which may be furniture.
    """
    plain = [t.strip().replace("\n", " ") for t in lines]
    n, wide = len(lines), 0.6 * max(map(len, plain), default=0)
    odd = [len(t) < wide and (i < EDGE or i >= n - EDGE) for i, t in enumerate(plain)]
    out, starts, at = ["\n"], [], 1
    for i, t in enumerate(plain):
        starts.append(at)
        after = plain[i + 1] if i + 1 < n else ""
        apart = "\n" if i + 1 == n or odd[i] or odd[i + 1] else " " if _western(t[-1:]) or _western(after[:1]) else ""
        out += (t, apart)
        at += len(t) + len(apart)
    return "".join(out), starts


def _western(c: str) -> bool:
    return c.isascii() and c.isalpha()


class _Forms(dict):
    """Words as they are compared: the first letter's case set aside."""

    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[w] = f = w[:1].lower() + w[1:]
        return f


_FORMS = _Forms({"\n": "\n"})


def _words(lines: list[str], joint: str = "") -> list[str]:
    """The words of a page as they are compared, a line feed before and after each line; a word broken over two lines
    stands whole in both, with ``joint`` where it was broken."""
    text = "\n" + "\n".join(t.replace("\n", " ") for t in lines) + "\n"
    if _BROKEN.search(text):
        text = _BROKEN.sub(rf"\1{joint}\2\n\1{joint}\2", text)
    return [_FORMS[w] for w in _WORD_OR_LINE.findall(text)]


_COMPOUND = re.compile(r"(?<![A-Za-zÀ-ɏ0-9|])([A-Za-zÀ-ɏ0-9|]+)[-‐‑](?=([A-Za-zÀ-ɏ0-9|]+))")
_COUNTED = "kind string, t long, f1 string, f2 string, k1 string, k2 string, n long, whole long"


def _skeleton_of(w: str | None) -> str:
    return "" if w is None or w == "\n" else word_skeleton(w)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triples (kind T), pairs of neighbouring words (W) and compounds (P), with how often they occur; whole: how often
    the second word of a pair stands on one line."""
    names = ["kind", "t", "f1", "f2", "k1", "k2", "n", "whole"]
    pairs, compounds = Counter(), Counter()

    def flush() -> pd.DataFrame:
        rows = []
        for (a, b), n in pairs.items():
            x, y = a.replace("\x01", ""), b.replace("\x01", "")
            if x != "\n" or y != "\n":
                rows.append(("W", None, x, y, _skeleton_of(x), _skeleton_of(y), n, n if y == b else 0))
        rows += [("P", None, None, None, word_skeleton(a), word_skeleton(b), n, 0) for (a, b), n in compounds.items()]
        pairs.clear()
        compounds.clear()
        return pd.DataFrame(rows, columns=names).astype({"t": "Int64"})

    for b in batches:
        texts = [list(x) for x in b["text"]]
        for at in range(0, len(texts), 400):
            some = texts[at : at + 400]
            t, n = np.unique(_triples("".join(_stream(x)[0] for x in some))[1], return_counts=True)
            yield pd.DataFrame({"kind": "T", "t": t.view(np.int64), "f1": None, "f2": None, "k1": None, "k2": None, "n": n, "whole": 0}).astype({"t": "Int64"})
            for lines in some:
                w = _words(lines, "\x01")
                pairs.update(zip(w, w[1:]))
                for line in lines:
                    if "-" in line or "‐" in line or "‑" in line:
                        compounds.update(_COMPOUND.findall(line))
        if len(pairs) > 200_000:
            yield flush()
    yield flush()


def _unpack(c: Column) -> list[Column]:
    part = lambda k: F.shiftrightunsigned(c, k).bitwiseAND(F.lit((1 << 21) - 1))
    return [part(42).alias("left"), part(21).alias("f"), part(0).alias("right")]


def _best(df: DataFrame, keys: list[str], form: str, good: str, ratio: int) -> DataFrame:
    """keys, form, good: the rare forms of each context and the frequent one, which occurs ratio times as often, and AT_LEAST."""
    n = df.groupBy(*keys, form).agg(F.sum("n").alias("n"))
    top = F.max(F.struct("n", form)).over(Window.partitionBy(*keys))
    scored = n.withColumn("top", top)
    return scored.where((F.col("top")[form] != F.col(form)) & (F.col("top.n") >= AT_LEAST) & (F.col("top.n") >= ratio * F.col("n"))).select(*keys, form, F.col("top")[form].alias(good))


def misread_triples(counts: DataFrame) -> DataFrame:
    """t, good: the triples whose middle character is misread, and the code of the right one ('#' for a digit)."""
    pairs = [(ord(c), ord(r)) for c, r in GLYPH.items()] + [(ord(c), ord("#")) for c in (*_ALSO_DIGITS, "#")]
    classes = F.create_map(*[F.lit(v) for p in pairs for v in p])
    t = counts.where("kind = 'T'").groupBy("t").agg(F.sum("n").alias("n"))
    t = cut(t.select("t", "n", *_unpack(F.col("t"))).withColumn("rep", classes[F.col("f").cast("int")]), "triples")
    inside = lambda *c: " and ".join(f"{x} <> 10" for x in c)  # noqa: E731  a line feed is no context
    both = _best(t.where(inside("left", "right")), ["left", "rep", "right"], "f", "g", DOMINATES)
    left = _best(t.where(inside("left")), ["left", "rep"], "f", "gl", DOMINATES_ALONE)
    right = _best(t.where(inside("right")), ["rep", "right"], "f", "gr", DOMINATES_ALONE)
    j = t.join(both, ["left", "rep", "right", "f"], "left").join(left, ["left", "rep", "f"], "left").join(right, ["rep", "right", "f"], "left")
    number = F.col("rep") == ord("#")
    good = F.coalesce(F.col("g"), F.when(number, F.coalesce("gl", "gr")).when(F.col("gl") == F.col("gr"), F.col("gl")))
    return j.select("t", good.alias("good")).where("good is not null")


def misread_pairs(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of words with a misread one: f1, f2, g1, g2; counts of words and of compounds by skeleton)."""
    w = cut(counts.where("kind = 'W'").groupBy("f1", "f2", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")), "words")
    words = w.where("f2 <> '\n'").select(F.col("k2").alias("k"), F.col("f2").alias("f"), "n", "whole")  # each word once: as the second of a pair
    long_ = F.length("k") >= 3
    alone = _best(words.where(long_), ["k"], "f", "g", DOMINATES_ALONE)
    after = _best(w.where("length(k2) >= 3 and f2 <> '\n'"), ["k1", "k2"], "f2", "ga", DOMINATES)
    before = _best(w.where("length(k1) >= 3 and f1 <> '\n'"), ["k1", "k2"], "f1", "gb", DOMINATES)
    j = (
        w.join(after, ["k1", "k2", "f2"], "left").join(before, ["k1", "k2", "f1"], "left")
        .join(alone.select(F.col("k").alias("k1"), F.col("f").alias("f1"), F.col("g").alias("w1")), ["k1", "f1"], "left")
        .join(alone.select(F.col("k").alias("k2"), F.col("f").alias("f2"), F.col("g").alias("w2")), ["k2", "f2"], "left")
    )
    bad = j.select("f1", "f2", F.coalesce("w1", "gb").alias("g1"), F.coalesce("w2", "ga").alias("g2")).where("g1 is not null or g2 is not null")
    vocabulary = words.groupBy("k").agg(F.sum("whole").alias("n"))
    compounds = counts.where("kind = 'P'").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    return bad, vocabulary, compounds


# ---- misread characters and words: where they are


def _pair_hash(a: str, b: str) -> int:
    h = folding._poly(a + "\x01" + b)
    return h - (1 << 64) if h >> 63 else h


class _Pairs(dict):
    def __missing__(self, p: tuple[str, str]) -> int:
        if len(self) > 300_000:
            self.clear()
        self[p] = h = _pair_hash(*p)
        return h


_PAIRS = _Pairs()


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """pid, e: every triple and every pair of words of a page, once; triples are not negative, pairs are hashes with the sign set."""
    for b in batches:
        for at in range(0, len(b), 400):
            ids, out = [], []
            for pid, x in zip(b["pid"].iloc[at : at + 400], b["text"].iloc[at : at + 400]):
                lines = list(x)
                t = np.unique(_triples(_stream(lines)[0])[1]).view(np.int64)
                w = _words(lines)
                h = {_PAIRS[p] | -(1 << 63) for p in zip(w, w[1:]) if p != ("\n", "\n")}
                out += [t, np.fromiter(h, dtype=np.int64, count=len(h))]
                ids += [pid, pid]
            if out:
                yield pd.DataFrame({"pid": np.repeat(np.array(ids, dtype=np.int64), [len(o) for o in out]), "e": np.concatenate(out)})


def _place(text: str, s: int, e: int, prev: str | None, nxt: str | None, good: str) -> tuple[int, int, str] | None:
    """The fix of a word as far as it lies on this line."""
    here = text[s:e]
    word = next(w for a, b, w in _tokens(text, prev, nxt) if a == s)
    if "\x01" in word or "\x02" in word:
        parts = re.split("[\x01\x02]", word)
        at = 0 if "\x01" in word else len(parts) - 1
        rest = good
        if at == 0:
            tail = parts[1].lower()
            fixed = rest[: len(rest) - len(tail)] if rest.lower().endswith(tail) else rest[: len(here)]
        else:
            head = parts[0].lower()
            fixed = rest[len(head) :] if rest.lower().startswith(head) else rest[len(rest) - len(here) :]
        good = fixed
    if here[:1].isupper() and good and "\x02" not in word:
        good = good[:1].upper() + good[1:]
    return None if good.lower() == here.lower() and good[1:] == here[1:] else (s, e, good)


class Misreads:
    """What is misread in a page: triple -> code of the right character, pair of words -> right words."""

    def __init__(self, triples: dict[int, int], pairs: dict[tuple[str, str], tuple[str | None, str | None]]) -> None:
        self.triples, self.pairs = triples, pairs

    def lines(self, lines: list[str], body: list[bool]) -> list[str | None]:
        """The repaired text of each body line, or None."""
        fixes: list[list[tuple[int, int, str]]] = [[] for _ in lines]
        if self.triples:
            text, starts = _stream(lines)
            places, packed = _triples(text)
            for p, t in zip(places.tolist(), packed.view(np.int64).tolist()):
                good = self.triples.get(t)
                if good is not None:
                    i = int(np.searchsorted(starts, p, side="right")) - 1
                    k = p - starts[i] + len(lines[i]) - len(lines[i].lstrip())
                    c = text[p]
                    to = _ALSO_DIGITS[c] if good == ord("#") else chr(good)
                    fixes[i].append((k, k + 1, to))
        if self.pairs:
            for i, t in enumerate(lines):
                prev, nxt = (lines[i - 1] if i else None), (lines[i + 1] if i + 1 < len(lines) else None)
                tokens = _tokens(t, prev, nxt)
                f = ["\n", *(_FORMS[_plain_word(w)] for *_, w in tokens), "\n"]
                for j, (s, e, _) in enumerate(tokens, 1):
                    good = self.pairs.get((f[j - 1], f[j]), (None, None))[1] or self.pairs.get((f[j], f[j + 1]), (None, None))[0]
                    if good:
                        fix = _place(t, s, e, prev, nxt, good)
                        if fix:
                            fixes[i].append(fix)
        return [_apply(t, [x for x in fx if t[x[0] : x[1]] != x[2]]) if b else None for t, fx, b in zip(lines, fixes, body)]


def _apply(text: str, fixes: list[tuple[int, int, str]]) -> str | None:
    if not fixes:
        return None
    out, at = [], 0
    for s, e, to in sorted(fixes):
        if s >= at:
            out += [text[at:s], to]
            at = e
    return "".join([*out, text[at:]])


def fixed_lines(pages: DataFrame, marks: DataFrame, counts: DataFrame, bad_pairs: DataFrame) -> DataFrame:
    """pid, i, fixed: the body lines in which anything is misread."""
    of = F.udf(lambda a, b: _pair_hash(a, b) | -(1 << 63), "long")
    bad = misread_triples(counts).select(F.col("t").alias("e"), "good", F.lit(None).cast("string").alias("f1"), F.lit(None).cast("string").alias("f2"), F.lit(None).cast("string").alias("g1"), F.lit(None).cast("string").alias("g2"))
    bad = bad.unionAll(bad_pairs.select(of("f1", "f2").alias("e"), F.lit(None).cast("long").alias("good"), "f1", "f2", "g1", "g2"))
    bad = cut(bad, "misread")
    met = map_batches(pages.select("pid", F.col("x.text").alias("text")), _emit, "pid long, e long").join(bad, "e")
    known = met.groupBy("pid").agg(
        F.collect_list(F.when(F.col("good").isNotNull(), F.struct("e", "good"))).alias("t"), F.collect_list(F.when(F.col("f1").isNotNull(), F.struct("f1", "f2", "g1", "g2"))).alias("w")
    )
    wanted = pages.select("pid", F.col("x.text").alias("text")).join(known, "pid").join(marks, "pid", "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, text, t, w, m in zip(b["pid"], b["text"], b["t"], b["w"], b["m"]):
                furniture = set(m) if m is not None else set()
                model = Misreads({r["e"]: r["good"] for r in t}, {(r["f1"], r["f2"]): (r["g1"], r["g2"]) for r in w})
                lines = list(text)
                for i, fixed in enumerate(model.lines(lines, [k not in furniture for k in range(len(lines))])):
                    if fixed is not None:
                        rows.append((pid, i, fixed))
            yield pd.DataFrame(rows, columns=["pid", "i", "fixed"])

    return map_batches(wanted, repair, "pid long, i int, fixed string")


# ---- words that are split over lines


def _split_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for pid, i, text, nxt in zip(b["pid"], b["i"], b["text"], b["next"]):
            m = broken_end(text)
            if not m or not any(c.isalpha() for c in m[0]):
                continue
            a, n = word_skeleton(m[0]), _WORD.match((nxt or "").lstrip())
            if n and not any(c.isalpha() for c in n.group()):
                continue
            second = word_skeleton(n.group()) if n else ""
            joined = word_skeleton(m[0] + n.group()) if n else ""
            rows.append((pid, i, m[2] in "¬­", bool(n), a, second, joined))
        yield pd.DataFrame(rows, columns=["pid", "i", "soft", "follows", "a", "b", "joined"])


def split_words(pages: DataFrame, marks: DataFrame, vocabulary: DataFrame, compounds: DataFrame) -> DataFrame:
    """pid, i of body lines that end inside a word; the next body line may stand on the next page of the document."""
    ends = r"[-‐‑¬­]\s*$"
    n = F.size("x")
    # what lies around page ends, one row per page: the first lines that are not furniture
    heads = pages.select("pid", "doc", "page", F.slice(F.col("x.text"), F.lit(1), F.lit(EDGE + 1)).alias("h")).join(marks, "pid", "left")
    first = F.filter(F.transform("h", lambda t, i: F.when(~F.coalesce(F.array_contains("m", i), F.lit(False)), t)), lambda t: t.isNotNull())
    doc = Window.partitionBy("doc").orderBy("page", "pid")
    heads = heads.select("pid", F.lead(F.get(first, 0)).over(doc).alias("over"))
    broken = pages.where(F.exists("x", lambda v: v["text"].rlike(ends))).select("pid", n.alias("n"), F.posexplode(F.col("x.text")).alias("i", "text"), F.col("x.text").alias("all"))
    broken = broken.where(F.col("text").rlike(ends)).select("pid", "i", "text", F.slice("all", F.col("i") + 2, F.lit(EDGE + 1)).alias("after"))
    broken = broken.join(marks, "pid", "left").where(~F.coalesce(F.array_contains("m", F.col("i")), F.lit(False)))
    rest = F.filter(F.transform("after", lambda t, k: F.when(~F.coalesce(F.array_contains("m", (F.col("i") + 1 + k).cast("int")), F.lit(False)), t)), lambda t: t.isNotNull())
    keys = map_batches(broken.join(heads, "pid").select("pid", "i", "text", F.coalesce(F.get(rest, 0), F.col("over")).alias("next")), _split_keys, "pid long, i int, soft boolean, follows boolean, a string, b string, joined string")
    keys = cut(keys, "broken")
    firsts = compounds.groupBy("k1").agg(F.sum("n").alias("nf"))
    v = lambda c: vocabulary.select(F.col("k").alias(c), F.col("n").alias("n_" + c))
    k = (
        keys.join(v("a"), "a", "left").join(v("b"), "b", "left").join(v("joined"), "joined", "left")
        .join(compounds.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("n").alias("n_pair")), ["a", "b"], "left")
        .join(firsts.select(F.col("k1").alias("a"), "nf"), "a", "left").na.fill(0, ["n_a", "n_b", "n_joined", "n_pair", "nf"])
    )
    words = (F.col("n_a") >= AT_LEAST) & (F.col("n_b") >= AT_LEAST)
    return k.where(
        F.when(F.col("soft"), True)
        .when(F.col("follows"), F.when(F.col("n_joined") + F.col("n_pair") > 0, F.col("n_joined") >= F.col("n_pair")).otherwise(~words))
        .otherwise((F.col("nf") == 0) | (F.col("n_a") == 0))
    ).select("pid", "i")


def repaired(ocr_lines: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages; marks of furniture: pid, m; misread lines: pid, i, fixed; split lines: pid, i)."""
    pages = pages_of(scanned_lines(ocr_lines, blocks))
    marks = mark_furniture(pages)
    counts = map_batches(pages.select(F.col("x.text").alias("text")), _count, _COUNTED)
    counts = cut(counts.groupBy("kind", "t", "f1", "f2", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")), "counts")
    bad, vocabulary, compounds = misread_pairs(counts)
    return pages, marks, fixed_lines(pages, marks, counts, bad), split_words(pages, marks, vocabulary, compounds)


def _name(c: Column) -> Column:
    return F.when(c == "o", "ocr_lines.text").otherwise("blocks.text")


def defects(ocr_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """field_name, record_key, defect: furniture, split_word or misread; a block has each defect of its lines once."""
    pages, marks, fixed, split = repaired(ocr_lines, blocks)
    found = marks.select("pid", F.explode("m").alias("i"), F.lit("furniture").alias("defect"))
    found = found.unionAll(fixed.select("pid", "i", F.lit("misread").alias("defect"))).unionAll(split.select("pid", "i", F.lit("split_word").alias("defect")))
    per_page = found.groupBy("pid").agg(F.collect_set(F.struct("i", "defect")).alias("d"))
    at = pages.select("pid", F.col("x.field").alias("field"), F.col("x.key").alias("key")).join(per_page, "pid").select("field", "key", F.inline("d"))
    return at.select(_name(F.get("field", F.col("i"))).alias("field_name"), F.get("key", F.col("i")).alias("record_key"), "defect").distinct()


def paragraphs(ocr_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, run_id, start_page, start_line, text, field_name, record_key: body lines as continuous paragraphs, over page breaks.

    Lines of ocr_lines and of scanned blocks, each field by itself, as a page may stand in one of them only. record_key is
    the line_key or block_key in which the paragraph starts, start_line the line_no or, in a block, the line from 1.
    A paragraph ends with a line that closes a sentence and is clearly shorter than its page's lines, and around headings.
    """
    pages, marks, fixed, split = repaired(ocr_lines, blocks)
    edits = fixed.withColumn("split", F.lit(False)).unionByName(split.select("pid", "i", F.lit(None).cast("string").alias("fixed"), F.lit(True).alias("split")))
    edits = edits.groupBy("pid", "i").agg(F.max("fixed").alias("fixed"), F.max("split").alias("split"))
    body = pages.join(marks, "pid", "left").select("pid", "doc", "page", "m", F.posexplode("x").alias("i", "x")).where(~F.coalesce(F.array_contains("m", F.col("i")), F.lit(False)))
    lines = body.select("pid", "doc", "page", "i", "x.ord", "x.key", "x.sub", "x.field", "x.text").join(edits, ["pid", "i"], "left")
    lines = lines.withColumn("split", F.coalesce("split", F.lit(False))).withColumn("t", F.trim(F.coalesce("fixed", "text")))
    page = Window.partitionBy("doc", "page")
    order = page.orderBy("i")
    heading = F.col("t").rlike(r"^(?:[一二三四五六七八九十]+、|\d+\.\s)") & (F.length("t") <= 40)
    lines = lines.withColumn("wide", F.max(F.length("t")).over(page)).withColumn("heading", heading)
    closes = F.col("heading") | (F.col("t").rlike(r"[。.!?！？:：]$") & (F.length("t") < 0.85 * F.col("wide")))
    lines = lines.withColumn("starts", F.col("heading") | F.coalesce(F.lag(closes).over(order), F.lit(False)))
    lines = lines.withColumn("closed", closes)
    last = lines.groupBy("doc", "page").agg(F.max_by("closed", "i").alias("closed"), F.max(F.when(F.col("starts"), F.col("i"))).alias("s"))
    through = Window.partitionBy("doc").orderBy("page")
    fresh = F.coalesce(F.lag("closed").over(through), F.lit(True)).alias("fresh")
    last = last.select("doc", "page", fresh, "s")
    own = F.when(F.col("s").isNotNull(), F.struct("page", F.col("s").alias("i"))).when(F.col("fresh"), F.struct("page", F.lit(-9).alias("i")))
    before = through.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("carried", F.last(own, ignorenulls=True).over(before)).select("doc", "page", "fresh", "carried")
    at = F.last(F.when(F.col("starts"), F.struct("page", "i")), ignorenulls=True).over(order)
    here = F.struct(F.col("page"), F.lit(-9).alias("i"))
    lines = lines.withColumn("at", at).join(last, ["doc", "page"])
    start = F.coalesce(F.col("at"), F.when(F.col("fresh"), here), F.col("carried"), here)
    soft = F.when(F.col("split"), F.regexp_replace("t", r"\s*[-‐‑¬­]\s*$", "")).when(F.col("t").rlike(r"[A-Za-z0-9,.;:!?%)]$"), F.concat("t", F.lit(" "))).otherwise(F.col("t"))
    lines = lines.withColumn("start", start).withColumn("piece", soft)
    place = F.min(F.struct("page", "i", "pid", "field", "key", "sub", "ord")).alias("first")
    joined = lines.groupBy("doc", "start").agg(F.array_sort(F.collect_list(F.struct("page", "i", "piece"))).alias("x"), place)
    text = F.trim(F.array_join(F.transform("x", lambda y: y["piece"]), ""))
    line = F.when(F.col("field") == "b", F.col("sub") + 1).when(F.col("ord") > NO_ORDER, F.col("ord").cast("int"))
    return joined.select(text.alias("text"), "first.*").drop("page").join(pages.select("pid", "place.*"), "pid").select(
        "doc_id", "run_id", F.col("page").alias("start_page"), line.alias("start_line"), "text", _name(F.col("field")).alias("field_name"), F.col("key").alias("record_key")
    )
