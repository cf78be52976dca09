"""Reading level of each document, from 1 (any reader) to 5 (expert).

A proportional-odds regression with a ridge penalty, one per script (Chinese, other), over features of the text:
lexical diversity, rarity of words in the corpus, difficulty of words (the mean level of the graded
documents they stand in, cross-fitted), connectives, depth of clauses, and lengths. Its thresholds
are calibrated to the graded documents.

Word statistics are over all documents, in tables of SLOTS counters, a fixed size that hashing
bounds. The regression is fitted on at most MOST_GRADED graded documents (those of lowest hashed id).

Odd input: null, empty and blank texts have no level (null); a document graded several times counts
with each grade, at equal weight in all; null grades and grades outside 1 to 5 are left out; without
any graded document every level is null; repeated rows each have their level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finspark.llm import folding
from finspark.session import cut, map_batches

SLOTS, MOST_GRADED, FOLDS, RIDGE, SMOOTH = 1 << 18, 20_000, 5, 1.0, 2.0
#: Grades from which on a script has a regression of its own.
OWN_MODEL = 20
LEVELS = (1, 2, 3, 4, 5)

# Words that join clauses.
CONNECTIVES_ZH = "因为 所以 但是 但 然而 虽然 尽管 如果 倘若 若 则 且 并 而 以及 从而 因此 由于 鉴于 考虑到 进而 即便 即使 均 亦 遂 却 须 依 以 于 之 其 所 使 致使".split()
CONNECTIVES_EN = set(
    "because so but however although though if then and while whereas therefore thereby hence notwithstanding insofar whose which that "
    "to extent thus consequently until unless provided despite nor whether as since when after before".split()
)
_CONNECT_ZH = re.compile("|".join(sorted(CONNECTIVES_ZH, key=len, reverse=True)))
_EN_WORD = re.compile(r"[a-zà-ɏ]+(?:[-'][a-zà-ɏ]+)*")
_SENT = re.compile(r"[。！？!?]+|\.(?=\s|$)|\n{2,}")
_BREAK, _FIGURE, _WORDLIKE = re.compile(r"\s*[\r\n]\s*"), re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?"), re.compile(r"\w")
_CLAUSE = re.compile(r"[,，;；:：、（(]")
_SLOT: dict[str, int] = {}


def _slot(word: str) -> int:
    s = _SLOT.get(word)
    if s is None:
        if len(_SLOT) > 500_000:
            _SLOT.clear()
        s = _SLOT[word] = int(folding.mix(np.array([folding._poly(word)], dtype=np.uint64))[0] % np.uint64(SLOTS))
    return s


def sentences_of(text: str) -> list[str]:
    """Sentences in lower case, line breaks inside them taken out, digits masked."""
    t = folding.fold(text).lower()
    cjk = folding.is_cjk(t)
    if "\n" in t or "\r" in t:
        t = _BREAK.sub("" if cjk else " ", t)
    t = _FIGURE.sub("0", t)
    return [s for s in (x.strip() for x in _SENT.split(t)) if _WORDLIKE.search(s)]


_PART = np.zeros(0x110000, dtype=bool)
for _lo, _hi in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF), (0x61, 0x7A), (0x30, 0x30)):
    _PART[_lo : _hi + 1] = True
_EMPTY = np.empty(0, dtype=np.int64)


def tokens(sentences: list[str], cjk: bool) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sentence numbers) of the tokens of a text: character bigrams for Chinese, words otherwise."""
    if not sentences:
        return _EMPTY, _EMPTY
    if cjk:
        codes = np.frombuffer("\n".join(sentences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        part = _PART[codes]
        pair = part[:-1] & part[1:]
        wide = codes.astype(np.uint64)
        with np.errstate(over="ignore"):
            h = folding.mix(wide[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + wide[1:][pair])
        return (h % np.uint64(SLOTS)).astype(np.int64), np.cumsum(codes == 10)[:-1][pair]
    words = [[_slot(w) for w in _EN_WORD.findall(x)] for x in sentences]
    flat = np.array([s for w in words for s in w], dtype=np.int64)
    return flat, np.repeat(np.arange(len(words)), [len(w) for w in words])


#: What features() gives, in order.
FEATURES = (
    "level", "level_by_weight", "level_of_sentences", "q10", "q25", "q50", "q75", "q90", "hard", "hard_by_weight", "middling", "seen",
    "rarity", "rarity_high", "diversity", "length", "longest", "clauses", "clause_length", "connectives", "connectives_by_length", "word_length",
)


def features(text: str, rarity: np.ndarray, difficulty: np.ndarray, seen: np.ndarray) -> tuple[bool, list[float]] | None:
    """(script, features) of a text, zeros where it has no token (only emoji, marks, other scripts); None if blank."""
    if not text or not text.strip():
        return None
    s = sentences_of(text)
    cjk = folding.is_cjk("".join(s))
    all_, of = tokens(s, cjk)
    if not len(all_):
        return cjk, [0.0] * len(FEATURES)
    weight = np.bincount(of, minlength=len(s)).astype(float)
    has = weight > 0
    level = difficulty[all_]
    hard = np.bincount(of, weights=level, minlength=len(s))[has] / weight[has]
    s, weight = [x for x, h in zip(s, has) if h], weight[has]
    count = len(s)
    length = [float(len(x)) if cjk else float(x.count(" ") + 1) for x in s]
    clauses = [1.0 + len(_CLAUSE.findall(x)) for x in s]
    joins = [float(len(_CONNECT_ZH.findall(x))) if cjk else float(sum(w in CONNECTIVES_EN for w in x.split())) for x in s]
    ordered, above, total = np.sort(hard), hard >= 3.5, weight.sum()
    quantiles = np.interp([0.1, 0.25, 0.5, 0.75, 0.9], np.linspace(0, 1, count), ordered) if count > 1 else np.repeat(ordered, 5)
    rare = rarity[all_]
    rare_high = np.partition(rare, int(0.9 * (len(rare) - 1)))[int(0.9 * (len(rare) - 1))]
    words = text.split()
    return cjk, [
        float(level.mean()),
        float(hard @ weight / total),
        float(hard.mean()),
        *quantiles.tolist(),
        float(above.mean()),
        float(weight @ above / total),
        float((hard >= 2.5).mean()),
        float((seen[all_] > 0).mean()),
        float(rare.mean()),
        float(rare_high),
        float(len(np.unique(all_)) / np.sqrt(len(all_))),
        float(np.log(sum(length) / count)),
        float(np.log(max(length))),
        sum(clauses) / count,
        sum(a / b for a, b in zip(length, clauses)) / count / 10,
        sum(joins) / count,
        sum(a / b for a, b in zip(joins, length)) / count * 10,
        0.0 if cjk else sum(map(len, words)) / len(words) / 10,
    ]


@dataclass
class Ordinal:
    """Proportional odds: P(level > k) = sigmoid(w . x - cut_k)."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cuts: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def level(self, x: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x)[:, None] > self.cuts[None, :]).sum(1)


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 400) -> Ordinal:
    """Ridge proportional-odds regression, by gradient steps with momentum on standardised features."""
    mean, scale = np.average(x, axis=0, weights=weight), x.std(0) + 1e-9
    z = (x - mean) / scale
    k = len(LEVELS) - 1
    above = (y[:, None] > np.arange(1, k + 1)[None, :]).astype(float)
    share = np.clip(np.average(above, axis=0, weights=weight), 1e-3, 1 - 1e-3)
    w, cuts = np.zeros(z.shape[1]), -np.log(share / (1 - share))
    m = [np.zeros_like(w), np.zeros_like(cuts)]
    v = [np.zeros_like(w), np.zeros_like(cuts)]
    total = weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - cuts[None, :], -30, 30)))
        d = (p - above) * weight[:, None] / total
        grads = [z.T @ d.sum(1) + ridge * w / total, -d.sum(0)]
        for i, (g, part) in enumerate(zip(grads, (w, cuts))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            part -= 0.15 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8) * min(1.0, 4 * (1 - t / (steps + 1)))
    return Ordinal(mean, scale, w, np.sort(cuts))


@dataclass
class Model:
    """What scoring needs, of a fixed size."""

    rarity: np.ndarray
    difficulty: np.ndarray
    seen: np.ndarray
    by_script: dict

    def levels(self, texts: list[str | None]) -> list[int | None]:
        """The level of each text, None without text."""
        out: list[int | None] = [None] * len(texts)
        rows: dict[bool, list[tuple[int, list[float]]]] = {True: [], False: []}
        for i, t in enumerate(texts):
            f = features(t, self.rarity, self.difficulty, self.seen) if t else None
            if f:
                rows[f[0]].append((i, f[1]))
        for script, some in rows.items():
            if some:
                for (i, _), v in zip(some, self.by_script[script].level(np.array([x for _, x in some])).tolist()):
                    out[i] = v
        return out


def _slots_of(text: str | None) -> np.ndarray:
    s = sentences_of(text) if text and text.strip() else []
    return tokens(s, folding.is_cjk("".join(s)))[0]


def graded_documents(documents: DataFrame, labels: DataFrame, most: int = MOST_GRADED) -> DataFrame:
    """doc_id, text, grades, fold: at most ``most`` documents with grades."""
    good = labels.where("doc_id is not null and reading_level between 1 and 5").groupBy("doc_id").agg(F.sort_array(F.collect_list("reading_level")).alias("grades"))
    rank = F.xxhash64("doc_id")
    chosen = good.orderBy(rank, "doc_id").limit(most)
    docs = documents.select("doc_id", "text").where("text is not null and length(trim(text)) > 0")
    return docs.join(chosen, "doc_id").withColumn("fold", F.pmod(rank, F.lit(FOLDS)).cast("int"))


def corpus_rarity(documents: DataFrame) -> np.ndarray:
    """Negative log share of each slot over all tokens of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            slots = [_slots_of(t) for t in b["text"]]
            if slots:
                n += np.bincount(np.concatenate(slots), minlength=SLOTS)
        at = n.nonzero()[0]
        yield pd.DataFrame({"slot": at, "n": n[at]})

    rows = map_batches(documents.select("text"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SLOTS)
    n[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return -np.log((n + 1) / (n.sum() + SLOTS))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model for a corpus and its grades, or None without grades.

    A script without OWN_MODEL grades is scored by a regression over the grades of both scripts.
    """
    graded = cut(graded_documents(documents, labels), "graded")  # MOST_GRADED rows, read twice

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y = np.zeros((FOLDS, SLOTS)), np.zeros((FOLDS, SLOTS))
        for b in batches:
            for t, g, f in zip(b["text"], b["grades"], b["fold"]):
                s = np.unique(_slots_of(t))
                n[f, s] += 1
                y[f, s] += float(np.mean(g))
        f, s = n.nonzero()
        yield pd.DataFrame({"fold": f.astype(np.int32), "slot": s, "n": n[f, s], "y": y[f, s]})

    rows = map_batches(graded, sums, "fold int, slot long, n double, y double").groupBy("fold", "slot").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas()
    if rows.empty:
        return None
    n, y = np.zeros((FOLDS, SLOTS)), np.zeros((FOLDS, SLOTS))
    at = rows["fold"].to_numpy(dtype=int), rows["slot"].to_numpy(dtype=np.int64)
    n[at], y[at] = rows["n"].to_numpy(), rows["y"].to_numpy()

    def table(folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        a, b = n[folds].sum(0), y[folds].sum(0)
        prior = b.sum() / max(a.sum(), 1)
        return ((b + SMOOTH * prior) / (a + SMOOTH)).astype(np.float32), (a > 0).astype(np.float32)

    rarity = corpus_rarity(documents).astype(np.float32)
    crossed = [table([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, g, f in zip(b["text"], b["grades"], b["fold"]):
                x = features(t, rarity, *crossed[f])
                if x is not None:
                    out += [(x[0], x[1], int(v), 1.0 / len(g)) for v in g]
            yield pd.DataFrame(out, columns=["cjk", "x", "level", "weight"])

    data = map_batches(graded, describe, "cjk boolean, x array<double>, level int, weight double").toPandas()
    if data.empty:
        return None
    by_script = {}
    for script in (True, False):
        own = data[data["cjk"] == script]
        d = own if len(own) >= OWN_MODEL else data
        by_script[script] = fit_ordinal(np.array(d["x"].tolist()), d["level"].to_numpy(), d["weight"].to_numpy())
    return Model(rarity, *table(list(range(FOLDS))), by_script)


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, reading_level: one row per document, null without text. Scoring is one pass without a shuffle."""
    model = fit(documents, labels)
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("int").alias("reading_level"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id"]].assign(reading_level=pd.array(model.levels(list(b["text"])), dtype="Int32"))

    return map_batches(documents.select("doc_id", "text"), score, "doc_id long, reading_level int")


def hard_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of documents of level 4 or 5."""
    return reading_levels(documents, labels).where("reading_level >= 4").select("doc_id")


def level_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, lang, reading_level, documents."""
    levels = reading_levels(documents, labels).where("reading_level is not null")
    return levels.join(documents.select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang", "reading_level").agg(F.count("*").alias("documents"))
