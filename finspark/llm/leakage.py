"""Held-out texts that stand in a training corpus.

Every sentence of a held-out item is cut into pieces; all pieces of all items are searched at once in
every document by the Wu-Manber method: a table of block shifts skips positions at which no piece can
end, blocks with shift zero lead to the few pieces that end in them, and direct comparison confirms.
Pieces that hit are put back to sentences: a sentence counts as carried where the document, beside the
hits, reads like it but for a few words; every place with enough hits is compared. A sentence shorter than a
piece is searched whole, in a table of its own, and counts where it stands word for word. A document carries an
item when the sentences carried hold at least CARRIED of the item's own text.

Compared without regard to case, blanks, line breaks and character forms. A sentence that several items have counts for
each of them. Only standard closing lines identify no item and are left out of both sides of the share: sentences with
which items end that have nothing else in common. They are looked for over all items, in Spark.

Odd input: null, empty and blank texts carry nothing and are no items; an item of nothing but
closing lines never leaks; repeated rows are each judged; the texts of an item_id that stands with several are items of their own.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finspark.llm import folding
from finspark.session import cut, map_batches

#: Length of a piece and of a block, for Chinese and for other texts; share of a sentence that must read the same;
#: share of an item's text that must be carried.
PIECE_CJK, PIECE, BLOCK_CJK, BLOCK = 7, 16, 2, 3
LIKE, CARRIED = 0.78, 0.4
#: Characters of items that are searched for at once and sent to the workers; items beyond go out in further passes.
CHARS_PER_PASS = 4_000_000


class WuManber:
    """Multi-pattern search; the shortest pattern gives the window, longer ones are compared from its start."""

    def __init__(self, patterns: dict[str, list], block: int) -> None:
        self.length = min(map(len, patterns))
        self.block = min(block, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[str, int] = {}
        ends: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            head = p[: self.length]
            for j in range(self.block, self.length + 1):
                b = head[j - self.block : j]
                self.shift[b] = min(self.shift.get(b, self.default), self.length - j)
            ends[head[-self.block :]][head[: self.block]].append(p)  # suffix block, then prefix
        self.ends = {k: dict(v) for k, v in ends.items()}

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, pattern) of every occurrence."""
        m, b, n = self.length, self.block, len(text)
        shift, default, ends = self.shift.get, self.default, self.ends
        i = m
        while i <= n:
            last = text[i - b : i]
            s = shift(last, default)
            if s:
                i += s
                continue
            for p in ends[last].get(text[i - m : i - m + b], ()):
                if text.startswith(p, i - m):
                    yield i - m, p
            i += 1


class Items:
    """Held-out items, ready to be searched for: (item, its sentences)."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.total: dict[int, int] = {}
        self.sentences: list[tuple[int, str, bool, Counter]] = []
        pieces: dict[bool, dict[str, list]] = {True: defaultdict(list), False: defaultdict(list)}
        short: dict[bool, dict[str, list]] = {True: defaultdict(list), False: defaultdict(list)}
        for item, own in rows:
            self.total[item] = sum(map(len, own))
            for s in own:
                cjk = folding.is_cjk(s)
                n, k = (PIECE_CJK if cjk else PIECE), len(self.sentences)
                if len(s) < n:
                    short[cjk][s].append((k, 0))
                else:
                    for at in sorted({*range(0, len(s) - n + 1, n), len(s) - n}):
                        pieces[cjk][s[at : at + n]].append((k, at))
                self.sentences.append((item, s, cjk, Counter(s)))
        self.search = [(WuManber(dict(p), BLOCK_CJK if cjk else BLOCK), p) for kind in (pieces, short) for cjk, p in kind.items() if p]

    def likeness(self, k: int, text: str, at: int) -> float:
        """Share of the sentence that the text reads the same around a place; 0 where it cannot reach LIKE."""
        _, sentence, cjk, letters = self.sentences[k]
        slack = 6 + len(sentence) // 6
        lo = max(0, at - slack)
        window = text[lo : at + len(sentence) + slack]
        if sum((letters & Counter(window)).values()) < LIKE * len(sentence):
            return 0.0  # no order of them could read the same
        blocks = SequenceMatcher(None, sentence, window, False).get_matching_blocks()
        least = 2 if cjk else 3
        return sum(b.size for b in blocks if b.size >= least) / len(sentence)

    def carried(self, text: str | None) -> dict[int, float]:
        """Item -> share of its own text that the document carries, for items of which it carries any sentence."""
        if not text or not text.strip():
            return {}
        t = folding.bare(text)
        hits: dict[int, Counter] = defaultdict(Counter)
        got: dict[int, int] = defaultdict(int)
        whole: set[int] = set()
        for wm, places in self.search:
            for start, p in wm.find(t):
                for k, at in places[p]:
                    if len(p) == len(self.sentences[k][1]):
                        whole.add(k)
                    else:
                        hits[k][(start - at) // 8] += 1
        for k in whole:
            got[self.sentences[k][0]] += len(self.sentences[k][1])
        for k, starts in hits.items():
            item, sentence, cjk, _ = self.sentences[k]
            need = max(1, round(0.3 * (len(sentence) // (PIECE_CJK if cjk else PIECE))))
            for d, n in starts.most_common():
                if n + starts.get(d + 1, 0) + starts.get(d - 1, 0) >= need and self.likeness(k, t, d * 8 + 4) >= LIKE:
                    got[item] += len(sentence)
                    break
        return {i: n / self.total[i] for i, n in got.items()}


def closing_lines(s: DataFrame) -> DataFrame:
    """s: the sentences of standard closing lines.

    Texts that end alike share a closing line where two of them have no sentence in common before it, and where it is
    less than CARRIED of the text of two item_ids at least. Each text is compared with one of those that end alike.
    """
    text = ["item_id", "h"]
    texts = s.groupBy(*text).agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x")).select(*text, F.col("x.s").alias("x"))
    small = F.when(F.col("tail") < CARRIED * F.col("chars"), F.col("item_id"))
    first = F.min(F.when(F.col("k") > 0, F.struct(*text, "k")))
    alike = s.groupBy("e").agg(F.countDistinct(small).alias("items"), first.alias("a")).where("items > 1")
    pairs = s.where("k > 0").join(alike, "e").select("e", *text, F.col("k").alias("kb"), F.col("a.item_id").alias("ia"), F.col("a.h").alias("ha"), F.col("a.k").alias("ka"))
    pairs = pairs.join(texts.withColumnRenamed("x", "xb"), text).join(texts.select(F.col("item_id").alias("ia"), F.col("h").alias("ha"), F.col("x").alias("xa")), ["ia", "ha"])
    unlike = pairs.where(~F.arrays_overlap(F.slice("xa", F.lit(1), F.col("ka")), F.slice("xb", F.lit(1), F.col("kb"))))
    return unlike.select(F.explode(F.slice("xb", F.col("kb") + 1, F.size("xb") - F.col("kb"))).alias("s")).distinct()


def own_sentences(eval_items: DataFrame) -> DataFrame:
    """item, item_id, own: the sentences of each item but for standard closing lines, one row per item_id and text."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, t in zip(b["item_id"], b["h"], b["text"]):
                found, seen, e, tail = folding.sentences(t), set(), b"", 0
                ends = []
                for s in reversed(found):
                    e, tail = blake2b(e + s.encode("utf-8", "surrogatepass"), digest_size=16).digest(), tail + len(s)
                    ends.append((e.hex(), tail))
                for k, (s, (e, n)) in enumerate(zip(found, reversed(ends))):
                    rows.append((i, h, k, s, s not in seen, e, n, tail))
                    seen.add(s)
            yield pd.DataFrame(rows, columns=["item_id", "h", "k", "s", "once", "e", "tail", "chars"])

    items = eval_items.where("item_id is not null and text is not null").select("item_id", "text", F.xxhash64("text").alias("h")).dropDuplicates(["item_id", "h"])
    s = cut(map_batches(items.select("item_id", "h", "text"), split, "item_id long, h long, k int, s string, once boolean, e string, tail long, chars long"), "sentences")
    own = s.where("once").join(closing_lines(s), "s", "left_anti").groupBy("item_id", "h").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("own"))
    return cut(own.select(F.xxhash64("item_id", "h").alias("item"), "item_id", F.col("own.s").alias("own")), "items")


def leaks(eval_items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id, share: documents that carry at least CARRIED of an item. The corpus is read once per pass, without a shuffle.

    Items are the stated query set. A pass holds the items of one hash class, about CHARS_PER_PASS characters, on the
    driver and the workers; the result does not depend on how many there are.
    """
    own = own_sentences(eval_items)
    chars = own.agg(F.sum(F.aggregate("own", F.lit(0).cast("long"), lambda n, s: n + F.length(s)))).collect()[0][0] or 0
    passes, out = max(1, math.ceil(chars / CHARS_PER_PASS)), None
    names = own.select("item", "item_id")
    for k in range(passes):
        rows = own.where(F.pmod("item", F.lit(passes)) == k).select("item", "own").collect()
        items = Items([(r.item, r.own) for r in rows])

        def one(batches: Iterator[pd.DataFrame], items: Items = items) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(i, d, s) for d, t in zip(b["doc_id"], b["text"]) for i, s in items.carried(t).items() if s >= CARRIED]
                yield pd.DataFrame(found, columns=["item", "doc_id", "share"])

        found = map_batches(documents.select("doc_id", "text").where("text is not null"), one, "item long, doc_id long, share double")
        found = cut(found, "leaks") if passes > 1 else found  # one pass is done before the next is built
        out = found if out is None else out.unionAll(found)
    return out.join(names, "item").select("item_id", "doc_id", "share")


def leaked_pairs(eval_items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id of every leak."""
    return leaks(eval_items, documents).select("item_id", "doc_id").distinct()


def leaked_items(eval_items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, split, documents, most: the items that leaked, into how many documents and how fully."""
    n = leaks(eval_items, documents).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 4).alias("most"))
    return n.join(eval_items.select("item_id", "split").distinct(), "item_id").select("item_id", "split", "documents", "most")
