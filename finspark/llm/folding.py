"""Text as it is compared: character forms, blanks, line breaks and letter case set aside.

Needs no corpus, unlike ``lookalikes``, and is used where only comparison counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

from finspark.llm.lookalikes import SAME_SHAPE

_ODD = {chr(c): "" for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"} | {a: b for a, b in SAME_SHAPE}


def _class_of(chars: list[str]) -> str:
    """A character class of ranges, which is searched much faster than one of single characters."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs) + "]"


_ODD_RE = re.compile("|".join(_class_of([c for c in _ODD if (c > "\uffff") == far]) for far in (False, True)))
_SENTENCE = re.compile(r"[。！？!?…]+[”’\"'）)]*|\.(?<=[^\s.]\.)(?=\s|$|[A-ZÀ-Þ一-鿿])|[\r\n]{2,}")
_WORDLIKE = re.compile(r"\w")
_CJK = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]+")


def fold(text: str) -> str:
    """One character form; blanks and case are kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    if _ODD_RE.search(text):
        text = unicodedata.normalize("NFC", _ODD_RE.sub(lambda m: _ODD[m.group()], text))
    return text


def bare(text: str) -> str:
    """One character form, lower case, no blanks at all."""
    return "".join(fold(text).split()).lower()


def sentences(text: str) -> list[str]:
    """The sentences of a text, each as ``bare`` gives it, without empty ones."""
    t = fold(text)
    # a single line break may fall anywhere, also within a word
    out, at = [], 0
    for m in _SENTENCE.finditer(t):
        out.append(t[at : m.end()])
        at = m.end()
    out.append(t[at:])
    found = "".join("\x00".join(out).lower().split()).split("\x00")
    return [s for s in found if _WORDLIKE.search(s)]


def is_cjk(text: str) -> bool:
    """Whether at least a tenth of the characters are CJK."""
    return not text.isascii() and len("".join(_CJK.findall(text))) * 10 >= max(len(text), 1)


def gram_hashes(parts: list[str], n: int) -> np.ndarray:
    """64-bit hashes of the character n-grams within each part, in order; a shorter part is one gram."""
    out = []
    long_ = [p for p in parts if len(p) >= n]
    if long_:
        codes = np.frombuffer("".join(long_).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(codes, n)
        keep = np.ones(len(windows), dtype=bool)
        ends = np.cumsum([len(p) for p in long_])
        for e in ends[:-1]:
            keep[e - n + 1 : e] = False
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64))
            out.append(mix((windows * powers).sum(1, dtype=np.uint64)[keep]))
    short = [p for p in parts if p and len(p) < n]
    if short:
        with np.errstate(over="ignore"):
            out.append(mix(np.array([_poly(p) for p in short], dtype=np.uint64)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _poly(p: str) -> int:
    h = len(p)
    for c in p:
        h = (h * 0x100000001B3 + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes that spreads them."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    row = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        diagonal, row[0] = row[0], x
        best = x
        for y, cb in enumerate(b, 1):
            diagonal, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, diagonal + (ca != cb))
            best = min(best, row[y])
        if best > most:
            return most + 1
    return min(row[-1], most + 1)
