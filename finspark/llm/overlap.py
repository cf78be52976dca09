"""The same or nearly the same records on both sides of a split.

A text is the multiset of its sentences, folded so that character forms, spacing, line breaks and letter
case do not count; two sentences agree where they differ by at most ``edits_allowed`` characters; two texts
are nearly the same where AGREE of the sentences of the larger one have a partner.

The join is exact for this definition. It is a prefix filter on rare elements, held-out side indexed,
training side probing:

* Of the n sentences of a held-out text at most n - ceil(AGREE * n) may lack a partner, so KEEP of any
  n - ceil(AGREE * n) + KEEP of them have one (or all that must, where those are fewer). That many are taken as
  its prefix: the rarest over all texts, by exact counts, then the longest.
* A sentence that may be edited in d places is cut into d + 1 shingles of one length, the first half of them
  counted from its start, the others from its end. An edited partner keeps one of them whole. Taken from the
  outside to the inside, it keeps one that stands behind at most as many edits as shingles lie before it, so
  the j-th shingle moved by j places at most (position filter). The training side emits its shingles, the
  prefixes emit their text at these places.
* Shingles meet on equal hashes. What meets must have numbers of sentences and characters that can agree
  (length filter) and, of 128 bits set by pairs of neighbouring characters, differ in no more than the edits can
  change. The pairs of texts that are left are verified sentence by sentence.

Exact copies are one class throughout, so that a hot text meets as one; pairs of documents are expanded
from the classes at the end.

Odd input: null, empty and blank contents pair with nothing; a document of several deliveries is one
document, and has every pair that one of its deliveries has; rows of other splits are left out; documents
without an id pair with nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finspark.llm import folding
from finspark.session import cut, map_batches

#: Share of the sentences that must agree; characters a sentence may be edited in, at most, and characters for each edit.
AGREE, EDITS, PER_EDIT = 0.8, 3, 6
#: Sentences of a prefix that must meet a partner before two texts are compared.
KEEP = 2
#: Lengths of one shingle length: lengths are classed by their root to this base.
STEP = 1.25


def edits_allowed(length: int) -> int:
    """Edits within which two sentences agree, by the length of the longer one."""
    return min(EDITS, length // PER_EDIT)


def sentences_agree(a: str, b: str) -> bool:
    most = edits_allowed(max(len(a), len(b)))
    return folding.edit_distance(a, b, most) <= most


def agreement_of(x: list[str], y: list[str]) -> float:
    """Share of the sentences, of the text that has more, that have a partner of their own on the other side.

    Below AGREE it may be less than that, as nothing is compared further.
    """
    most = max(len(x), len(y))
    if not most:
        return 0.0
    a, b = Counter(x), Counter(y)
    same = a & b
    left, right = list((a - same).elements()), list((b - same).elements())
    agreed = same.total()
    if agreed + min(len(left), len(right)) < AGREE * most:
        return agreed / most
    lacking, partners = len(left) + agreed - math.ceil(AGREE * most - 1e-9), []
    for s in left:
        partners.append([j for j, t in enumerate(right) if sentences_agree(s, t)])
        lacking -= not partners[-1]
        if lacking < 0:
            return agreed / most
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in partners[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return (agreed + sum(place(i, set()) for i in range(len(left)))) / most


def agreement(a: str, b: str) -> float:
    """``agreement_of`` for two texts."""
    return agreement_of(folding.sentences(a), folding.sentences(b))


def sketches(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per sentence 128 bits, as two numbers, set by its pairs of neighbouring characters; no sentence is empty."""
    if not sentences:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    codes = np.frombuffer("".join(sentences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(s) for s in sentences])
    ends = np.cumsum(sizes)
    after = np.concatenate([codes[1:], np.zeros(1, dtype=np.uint64)])
    after[ends - 1] = 0
    with np.errstate(over="ignore"):
        h = folding.mix(codes * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(57)
    bit = np.uint64(1) << (h & np.uint64(63))
    halves = (np.where(h < 64, bit, np.uint64(0)), np.where(h < 64, np.uint64(0), bit))
    low, high = (np.bitwise_or.reduceat(v, ends - sizes).view(np.int64) for v in halves)
    return low, high


_READ = "document_id string, train boolean, text array<string>, lo array<long>, hi array<long>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of each text, in one order, and their sketches; texts without words are left out."""
    for b in batches:
        ids, train, texts = [], [], []
        for i, split, t in zip(b["document_id"], b["split"], b["content"]):
            s = folding.sentences(t)
            if s:
                ids.append(i)
                train.append(split == "train")
                texts.append(sorted(s))
        if not texts:
            continue
        ends = np.cumsum([len(s) for s in texts])[:-1]
        low, high = (pd.Series(np.split(v, ends), dtype=object) for v in sketches([x for s in texts for x in s]))
        yield pd.DataFrame({"document_id": ids, "train": train, "text": texts, "lo": low, "hi": high})


def read_sentences(rows: DataFrame) -> DataFrame:
    """document_id, train, c, c2, s: class of each text (128 bits of its sentences in any order) and its sentences.

    s: i, h (hash), n (length), lo, hi, text. One pass over the texts, without a shuffle.
    """
    r = map_batches(rows.select("document_id", "split", "content"), _read, _READ)
    parts = F.transform(
        F.arrays_zip("text", "lo", "hi"),
        lambda x, i: F.struct(i.alias("i"), F.xxhash64(x["text"]).alias("h"), F.length(x["text"]).alias("n"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["text"].alias("text")),
    )
    return r.select("document_id", "train", F.xxhash64("text").alias("c"), F.xxhash64(F.lit(1), "text").alias("c2"), parts.alias("s"))


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def _shingle_length(d: Column, k: Column) -> Column:
    least = F.greatest(F.ceil(F.pow(F.lit(STEP), k.cast("double")) - 1e-9).cast("int"), d * (PER_EDIT - 1), F.lit(1))
    return F.greatest((least / (d + 1)).cast("int"), F.lit(1))


def _keys(text: Column, n: Column, d: Column, k: Column, moved: bool) -> Column:
    """Hashes of the shingles of a sentence; where ``moved``, at every place an edited partner may have them."""
    size, front = _shingle_length(d, k), F.floor((d + 2) / 2).cast("int")  # of d + 1 shingles this many count from the start

    def one(j: Column) -> Column:
        head = j < front
        i = F.when(head, j).otherwise(j - front)  # shingles outside of it
        at = F.when(head, i * size).otherwise(n - (i + 1) * size)
        shifts = F.sequence(-i, i) if moved else F.array(F.lit(0))
        inside = F.filter(shifts, lambda m: (at + m >= 0) & (at + m + size <= n))
        return F.transform(inside, lambda m: F.xxhash64(F.substring(text, at + m + 1, size), j, d, k))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), d), one)))


def _allowed(n: Column) -> Column:
    return F.least(F.lit(EDITS), F.floor(n / PER_EDIT).cast("int"))


def _probe(texts: DataFrame) -> DataFrame:
    """e, c, size, n, lo, hi: the shingles of every sentence of the training side."""
    s = texts.where("train").select("c", F.size("s").alias("size"), F.inline("s"))
    # the longer one of a pair sets the edits, so a sentence takes part as itself and as the shorter one
    s = s.withColumn("d", F.explode(F.array_distinct(F.array(_allowed(F.col("n")), _allowed(F.col("n") + EDITS)))))
    e = F.explode(_keys(F.col("text"), F.col("n"), F.col("d"), _length_class(F.col("n")), False))
    return s.select(e.alias("e"), "c", "size", "n", "lo", "hi")


def _index(texts: DataFrame) -> DataFrame:
    """e, c, size, i, n, lo, hi: where the shingles of the partners of each held-out prefix may be."""
    held = texts.where("held").select("c", "c2", F.size("s").alias("size"), "s")
    counts = texts.select(F.explode("s.h").alias("h")).groupBy("h").agg(F.count("*").alias("often"))
    s = held.select("c", "c2", "size", F.inline("s")).select("c", "c2", "size", "i", "h", "n").join(counts, "h")
    order = F.array_sort(F.collect_list(F.struct("often", (-F.col("n")).alias("short"), "i")))
    must = F.ceil(F.col("size") * AGREE - 1e-9).cast("int")
    take = F.max(F.col("size") - must + F.least(F.lit(KEEP), must))
    chosen = s.groupBy("c", "c2").agg(F.slice(order, F.lit(1), take).alias("p")).select("c", "c2", F.col("p.i").alias("p"))
    prefix = F.array_distinct(F.transform("p", lambda i: F.get("s", i)))
    s = held.join(chosen, ["c", "c2"]).select("c", "size", F.inline(prefix))
    n = F.col("n")
    spread = F.sequence(F.greatest(n - _allowed(n), F.lit(1)), n + _allowed(n + EDITS))
    pairs = F.array_distinct(F.transform(spread, lambda m: F.struct(_allowed(F.greatest(m, n)).alias("d"), _length_class(m).alias("k"))))
    s = s.select("c", "size", "i", "text", "n", "lo", "hi", F.inline(pairs))
    return s.select(F.explode(_keys(F.col("text"), n, F.col("d"), F.col("k"), True)).alias("e"), "c", "size", "i", "n", "lo", "hi")


def similar_classes(texts: DataFrame) -> DataFrame:
    """c_train, c_held of different texts, one trained on and one held out, that are nearly the same.

    texts: c, c2, s, train, held (whether a document of that side has the text); one row per class.
    """
    index = _index(texts).select("e", "i", F.col("c").alias("c_held"), F.col("size").alias("size_held"), F.col("n").alias("m"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    probe = _probe(texts).withColumnsRenamed({"c": "c_train", "size": "size_train"})
    most, least = F.greatest("size_held", "size_train"), F.least("size_held", "size_train")
    edits = _allowed(F.greatest("n", "m"))
    bits = F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2")))
    met = probe.join(index, "e").where((F.col("c_held") != F.col("c_train")) & (least >= F.ceil(AGREE * most - 1e-9)) & (F.abs(F.col("n") - F.col("m")) <= edits) & (bits <= 4 * edits))
    found = met.groupBy("c_train", "c_held").agg(F.countDistinct("i").alias("met"), F.first("size_held").alias("size"))
    pairs = cut(found.where(F.col("met") >= F.least(F.lit(KEEP), F.ceil(F.col("size") * AGREE - 1e-9))).select("c_train", "c_held"), "pairs")
    t = texts.where("train").select(F.col("c").alias("c_train"), F.col("s.text").alias("x"))
    h = texts.where("held").select(F.col("c").alias("c_held"), F.col("s.text").alias("y"))

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([agreement_of(list(a), list(b)) >= AGREE for a, b in zip(x, y)], dtype=bool)

    return pairs.join(t, "c_train").join(h, "c_held").where(agree("x", "y")).select("c_train", "c_held")


def split_overlaps(inputs: DataFrame) -> DataFrame:
    """document_id_a < document_id_b: one document of train, one of eval or holdout, with the same or nearly the same content."""
    rows = inputs.where("document_id is not null and content is not null and split in ('train', 'eval', 'holdout')").select("document_id", "split", "content")
    read = cut(read_sentences(rows), "read")
    texts = cut(read.groupBy("c", "c2").agg(F.first("s").alias("s"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held")), "texts")
    members = read.select("document_id", "c", "train").distinct()
    same = texts.where("train and held").select(F.col("c").alias("c_train"), F.col("c").alias("c_held"))
    links = same.unionAll(similar_classes(texts))
    t = members.where("train").select(F.col("c").alias("c_train"), F.col("document_id").alias("t"))
    e = members.where("not train").select(F.col("c").alias("c_held"), F.col("document_id").alias("e"))
    pairs = links.join(t, "c_train").join(e, "c_held").where("t <> e")
    return pairs.select(F.least("t", "e").alias("document_id_a"), F.greatest("t", "e").alias("document_id_b")).distinct()


def overlap_report(inputs: DataFrame) -> DataFrame:
    """split, source_file, documents, overlapping: per split and source, how many documents also stand on the other side."""
    pairs = split_overlaps(inputs)
    hit = pairs.select(F.explode(F.array("document_id_a", "document_id_b")).alias("document_id")).distinct().withColumn("hit", F.lit(1))
    docs = inputs.where("document_id is not null").select("document_id", "split", "source_file").distinct()
    return docs.join(hit, "document_id", "left").groupBy("split", "source_file").agg(
        F.countDistinct("document_id").alias("documents"), F.countDistinct(F.when(F.col("hit") == 1, F.col("document_id"))).alias("overlapping")
    )
