"""Printed numbers and unit spellings: exact parsing inside Spark's own expressions.

A quantity is kept as ``sign * digits * 10**e10`` with ``digits`` a string without leading or
trailing zeros, so that values of any length compare exactly and a change of scale adds to
``e10`` only. Zero is ``digits = '0'``, ``e10 = 0``, ``sign = 1``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 −‐‑–﹣’   "
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  ----" + "-'" + "   "


def to_half_width(c: Column) -> Column:
    """Full-width signs as ASCII, kinds of blank as a space, kinds of minus as a hyphen."""
    return F.translate(c, _WIDE, _ASCII)


def squeeze(c: Column) -> Column:
    """Half-width, lower case, without any blank: the form in which unit spellings are compared."""
    return F.regexp_replace(F.lower(to_half_width(c)), r"\s+", "")


_NUMBER = (
    r"^\s*([-+]?)(\(?)\s*([-+]?)(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:[eE]([-+]?\d{1,4}))?\s*(\)?)\s*(.*?)\s*$"
)


_SEP = "\u0001"


def parse_number(c: Column) -> Column:
    """struct(sign int, digits string, e10 int, suffix string) of a printed number, or null.

    Accepts grouping commas only in threes, accounting brackets, both minus signs, full width and
    exponents. Words before the number ("about 5"), two signs, or unbalanced brackets give null.
    ``suffix`` is what follows the number; the caller decides whether it is a unit.
    """
    # one pass of the pattern; the array is bound once by the lambda
    parts = F.split(F.regexp_replace(to_half_width(c), _NUMBER, _SEP.join(f"${i}" for i in range(1, 9))), _SEP)

    def read(g: Column) -> Column:
        before, bracket, inside, frac, exp, close = g[0], g[1], g[2], g[4], g[5], g[6]
        raw = F.ltrim(F.concat(F.replace(g[3], F.lit(","), F.lit("")), frac), F.lit("0"))
        digits = F.rtrim(raw, F.lit("0"))
        zero = digits == ""
        e10 = F.coalesce(exp.try_cast("int"), F.lit(0)) - F.length(frac) + F.length(raw) - F.length(digits)
        negative = (before == "-") | (inside == "-") | (bracket == "(")
        signs = F.length(before) + F.length(inside) + F.length(bracket)
        good = (F.size(g) == 8) & (g[3] != "") & (F.length(bracket) == F.length(close)) & (signs <= 1)
        return F.when(
            good,
            F.struct(
                F.when(negative & ~zero, F.lit(-1)).otherwise(F.lit(1)).alias("sign"),
                F.when(zero, F.lit("0")).otherwise(digits).alias("digits"),
                F.when(zero, F.lit(0)).otherwise(e10).cast("int").alias("e10"),
                g[7].alias("suffix"),
            ),
        )

    return F.transform(F.when(F.size(parts) == 8, F.array(parts)), read)[0]


def plain(sign: Column, digits: Column, e10: Column) -> Column:
    """The exact value as a plain decimal string (exponents beyond 400 stay in e-notation)."""
    n = F.length(digits)
    point = n + e10
    whole = F.concat(digits, F.repeat(F.lit("0"), F.greatest(e10, F.lit(0))))
    inside = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)
    body = (
        F.when(F.abs(e10) > 400, F.concat(digits, F.lit("e"), e10.cast("string")))
        .when(e10 >= 0, whole)
        .when(point > 0, inside)
        .otherwise(small)
    )
    return F.concat(F.when(sign < 0, F.lit("-")).otherwise(F.lit("")), body)


# Powers of ten of the scale words, Chinese and English.
SCALE_ZH = {
    "": 0, "十": 1, "百": 2, "千": 3, "仟": 3, "万": 4, "萬": 4, "十万": 5, "百万": 6, "千万": 7,
    "亿": 8, "億": 8, "十亿": 9, "百亿": 10, "千亿": 11, "万亿": 12,
}
SCALE_EN = {
    "": 0, "'000": 3, "000": 3, "k": 3, "thousand": 3, "thousands": 3, "m": 6, "mn": 6, "mm": 6, "mio": 6,
    "million": 6, "millions": 6, "bn": 9, "billion": 9, "billions": 9, "tn": 12, "trillion": 12,
}

#: Common unit of each dimension.
COMMON = {
    "money_cny": "yuan", "money_usd": "dollar", "share": "share", "per_share": "yuan per share",
    "per_share_usd": "dollar per share", "percent": "percent", "point": "percentage point",
    "mass": "kilogram", "energy": "kilowatt-hour",
}
#: Scales that a fact of a dimension may be printed in when it names none (the states of the unit model).
STATES = {
    "money_cny": (0, 3, 4, 6, 7, 8, 9), "money_usd": (0, 3, 4, 6, 8, 9), "share": (0, 4, 6, 8),
    "per_share": (-2, 0), "per_share_usd": (-2, 0), "percent": (-1, 0, 2), "point": (-2, 0),
    "mass": (0, 3, 6, 7, 9), "energy": (0, 3, 4, 6, 8),
}


def unit_table() -> list[tuple[str, str, int]]:
    """(spelling as squeezed, dimension, power of ten to the common unit), built from the scale words."""
    out: dict[str, tuple[str, int]] = {}

    def add(name: str, dim: str, e10: int) -> None:
        out.setdefault(re.sub(r"\s+", "", name.lower()), (dim, e10))

    for word, e in SCALE_ZH.items():
        for name in (f"{word}元", f"人民币{word}元", f"{word}元人民币", f"{word}人民币元", f"{word}人民币"):
            add(name, "money_cny", e)
        for name in (f"{word}美元", f"美元{word}元" if word else "美金", f"{word}美金"):
            add(name, "money_usd", e)
        add(f"{word}股", "share", e)
        add(f"{word}千瓦时", "energy", e)
        add(f"{word}度", "energy", e)
        add(f"{word}瓦时", "energy", e - 3)
        add(f"{word}克", "mass", e - 3)
        add(f"{word}公斤", "mass", e)
        for ton in ("吨", "公吨"):
            add(f"{word}{ton}", "mass", e + 3)
    for word, e in SCALE_EN.items():
        for cur in ("rmb", "cny", "yuan", "¥"):
            add(f"{cur}{word}", "money_cny", e)
            if word and not word.endswith("000"):
                add(f"{word}{cur}", "money_cny", e)
        for cur in ("usd", "us$", "$", "dollar", "dollars", "usdollar", "usdollars"):
            add(f"{cur}{word}", "money_usd", e)
            if word and not word.endswith("000"):
                add(f"{word}{cur}", "money_usd", e)
        if len(word) != 1 and not word.endswith("000"):
            for noun in ("share", "shares"):
                add(f"{word}{noun}", "share", e)
            for noun in ("tonne", "tonnes", "ton", "tons"):
                add(f"{word}{noun}", "mass", e + 3)
    for small, e in (("元", 0), ("角", -1), ("分", -2)):
        for form in (f"{small}/股", f"{small}每股", f"每股{small}", f"人民币{small}/股"):
            add(form, "per_share", e)
    for small, e in (("yuan", 0), ("rmb", 0), ("cny", 0), ("fen", -2), ("jiao", -1)):
        for form in (f"{small} per share", f"{small}/share"):
            add(form, "per_share", e)
    for small, e in (("美元", 0), ("美分", -2)):
        for form in (f"{small}/股", f"{small}每股"):
            add(form, "per_share_usd", e)
    for small, e in (("usd", 0), ("us$", 0), ("$", 0), ("cents", -2), ("cent", -2)):
        for form in (f"{small} per share", f"{small}/share"):
            add(form, "per_share_usd", e)
    for name, e in (("%", 0), ("percent", 0), ("per cent", 0), ("pct", 0), ("百分比", 0), ("‰", -1), ("permille", -1), ("千分比", -1), ("‱", -2), ("小数", 2), ("decimal", 2), ("fraction", 2)):
        add(name, "percent", e)
    for name in ("百分点", "个百分点", "percentage point", "percentage points", "pct pt", "pct pts", "ppt", "ppts", "pp"):
        add(name, "point", 0)
    for name in ("bp", "bps", "基点", "个基点", "basis point", "basis points"):
        add(name, "point", -2)
    for name, e in (("mg", -6), ("g", -3), ("kg", 0), ("kilogram", 0), ("kilograms", 0), ("t", 3), ("kt", 6), ("毫克", -6)):
        add(name, "mass", e)
    for name, e in (("wh", -3), ("kwh", 0), ("mwh", 3), ("gwh", 6), ("twh", 9), ("兆瓦时", 3), ("吉瓦时", 6)):
        add(name, "energy", e)
    return [(k, d, e) for k, (d, e) in sorted(out.items())]


def _alternation(least: int) -> str:
    names = [k for k, _, _ in unit_table() if not (k.isascii() and k.isalpha() and len(k) < least)]
    return "|".join(re.escape(k) for k in sorted(names, key=len, reverse=True))


#: Clauses that give the unit of other figures ("the ratio columns are in %").
_SIDE = r"[;,](?:另列|另有|另附|占比|比率|比例|其中|per-share)[^;,]*"
_UNIT_RE = _alternation(2)
_NAMED = (
    rf"(?:单位(?:均)?(?:为|是|:)?|以|\(|^in|[;,(]in|figuresin|amountsin|statedin|expressedin)({_UNIT_RE})"
    r"(?:计|列示|表示|\)|:|;|,|。|项目|$)"
)
_AFTER = rf"^\)?({_UNIT_RE})(?:[,;)。]|$)"


def unit_in_text(text: Column, value: Column) -> Column:
    """The unit spelling a sentence names for its figure, squeezed, or an empty string.

    Looks at phrases that declare a unit ("单位:万元", "(亿元)", "stated in RMB mn") and at what
    directly follows the printed value; clauses about other columns are left out first.
    """
    t = F.regexp_replace(squeeze(text), _SIDE, "")
    named = F.regexp_extract(t, _NAMED, 1)
    v = squeeze(value)
    after = F.when(
        (F.length(v) > 0) & t.contains(v), F.regexp_extract(F.call_function("substring_index", t, v, F.lit(-1)), _AFTER, 1)
    ).otherwise(F.lit(""))
    return F.when(named != "", named).otherwise(after)
