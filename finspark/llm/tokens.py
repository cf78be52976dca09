"""Encoding of texts with a byte-level pair-encoding vocabulary, by a streaming transducer.

A sequence of tokens is the encoding of its bytes exactly when every adjacent pair of tokens is the
encoding of its own bytes. So the last token of the encoding of every prefix can be computed from
left to right: among the vocabulary entries that end at a position (an automaton lists them), it is
the one that goes with the last token of the prefix before it. A token still to come starts where the
rest of the bytes is the beginning of an entry; where the encodings up to all such places part, the
boundary is stable, and the tokens before it are emitted and forgotten. How far back it can lie is
computed from the merges, the sufficient lookahead: a merge can be forestalled from the right only by a
merge of higher priority on its right-hand part, that one again only by one of still higher priority,
and so on, and the longest such chain in bytes bounds what can matter.

Every text goes through the transducer. Runs that the split pattern yields are encoded independently;
what came out for a run is kept in a bounded cache.
Empty and null texts have the empty list; blank texts are encoded as they stand. Characters that
UTF-8 cannot hold (lone surrogates) are encoded as the replacement character.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter, never copied.
TOKENIZERS = os.environ.get("FINSPARK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs kept in a worker's cache, and pairs of tokens whose test is kept.
CACHE, PAIRS = 300_000, 2_000_000


class Vocabulary:
    """Ranks of a byte-level vocabulary and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self._goes: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._lookahead: int | None = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: the adjacent pair of lowest rank is merged first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, t: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if t not in self._whole:
            self._whole[t] = self.merge(self.bytes[t]) == [t]
        return self._whole[t]

    def goes(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        known = self._goes.get((a, b))
        if known is None:
            if len(self._goes) >= PAIRS:
                self._goes.clear()
            known = self._goes[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def split(self, b: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token joins."""
        if len(b) < 2:
            return None
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a boundary that can matter for it, at most."""
        if self._lookahead is None:
            reach: dict[bytes, int] = {}  # by left part, over the merges of higher priority
            spine: dict[bytes, list[bytes]] = {}
            most = 0
            for b in sorted(self.ranks, key=self.ranks.__getitem__):
                parts = self.split(b)
                if parts is None:
                    spine[b] = [b]
                    continue
                left, right = parts
                spine[b] = [b, *spine.get(right, [right])]
                far = len(right) + max((reach.get(s, 0) for s in spine.get(right, [right])), default=0)
                most = max(most, far)
                for s in spine.get(left, [left])[:1]:
                    reach[s] = max(reach.get(s, 0), far)
            self._lookahead = most + self.longest
        return self._lookahead


class Transducer:
    """Bytes in, in pieces of any size; tokens out as soon as they are stable.

    The automaton goes on from piece to piece and gives every prefix its last token. A token that is still to come
    starts at a place whose rest is the beginning of a vocabulary entry; the boundary where the encodings up to all
    these places part is stable, and what lies before it is emitted and forgotten. The lookahead bounds how far that
    boundary can lie back, so what is kept is bounded too.
    """

    #: Bytes taken in before boundaries are looked for.
    STEP = 32

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.keeps = vocabulary.lookahead + vocabulary.longest + self.STEP
        self._new()

    def _new(self) -> None:
        self.matches = self.v.automaton.iter("")
        self.data, self.before, self.base = "", -1, 0  # bytes not emitted, the token before them, where they start
        self.last = [-1]  # last token of each prefix of data

    def _take(self, piece: str) -> None:
        last, base, goes, stands = self.last, self.base, self.v.goes, self.v.stands
        self.data += piece
        last += [-1] * len(piece)
        self.matches.set(piece)
        for end, (size, t) in self.matches:
            to = end + 1 - base
            at = to - size
            if at < 0 or last[to] >= 0:
                continue
            a = last[at] if at else self.before
            if (a < 0 and at == 0 and stands(t)) or (a >= 0 and goes(a, t) and stands(t)):
                last[to] = t

    def _stable(self) -> int:
        """The last boundary that nothing to come can change."""
        data, last, n = self.data, self.last, len(self.data)
        begins, size = self.v.automaton.match, self.v.sizes
        live = [i for i in range(max(0, n - self.v.longest + 1), n) if (not i or last[i] >= 0) and begins(data[i:])]
        ends = {*live, n}
        while len(ends) > 1:
            p = max(ends)
            ends.discard(p)
            ends.add(p - size[last[p]])
        return ends.pop()

    def _path(self, end: int) -> list[int]:
        out, size, last = [], self.v.sizes, self.last
        while end > 0:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]

    def feed(self, piece: bytes) -> list[int]:
        """Tokens that became stable."""
        out: list[int] = []
        text = piece.decode("latin-1")
        for i in range(0, len(text), self.STEP):
            self._take(text[i : i + self.STEP])
            if len(self.data) >= self.STEP:
                to = self._stable()
                if to:
                    out += self._path(to)
                    self.before, self.data, self.last, self.base = self.last[to], self.data[to:], [-1, *self.last[to + 1 :]], self.base + to
        return out

    def finish(self) -> list[int]:
        """The rest of the tokens; the transducer is as new afterwards."""
        out = self._path(len(self.data))
        self._new()
        return out


class Encoder:
    """Texts to ids, with a bounded cache of runs."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(PATTERN).finditer
        self.cache: dict[str, list[int]] = {}
        self.transducer = Transducer(vocabulary)

    def run(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        out = self.transducer.feed(data)
        out += self.transducer.finish()
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[text] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            text = "".join("�" if "\ud800" <= c <= "\udfff" else c for c in text)
        out: list[int] = []
        get, run = self.cache.get, self.run
        for m in self.split(text):
            w = m.group()
            out += get(w) or run(w)
        return out


class Decoder:
    """Ids to text, one at a time: a state machine over the bytes of UTF-8.

    The state is the bytes that are still due and the range the next one must lie in; what cannot go
    on is replaced, as the maximal parts of broken sequences are.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.due, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for t in ids:
            for b in self.v.bytes[t]:
                self._byte(b, out)
        return "".join(out)

    def _byte(self, b: int, out: list[str]) -> None:
        if self.due:
            if self.low <= b <= self.high:
                self.code, self.due, self.low, self.high = self.code << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                if not self.due:
                    out.append(chr(self.code))
                return
            out.append("�")
            self.due, self.low, self.high = 0, 0x80, 0xBF
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xDF:
            self.due, self.code = 1, b & 0x1F
        elif 0xE0 <= b <= 0xEF:
            self.due, self.code = 2, b & 0x0F
            self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.due, self.code = 3, b & 0x07
            self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
        else:
            out.append("�")

    def finish(self) -> str:
        rest, self.due, self.low, self.high = ("�" if self.due else ""), 0, 0x80, 0xBF
        return rest


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.load(path))
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def token_ids(text: Column, path: str) -> Column:
    """array<int> of token ids; empty for null and empty texts."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from finspark.llm.tokens import encoder as of  # the worker's own, kept over tasks

        e = of(path)
        for s in batches:
            yield pd.Series([e.encode(t) for t in s], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that ids stand for, decoded one at a time."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from finspark.llm.tokens import encoder as of

        d = Decoder(of(path).v)
        for s in batches:
            yield pd.Series([None if x is None else d.feed(x) + d.finish() for x in s], dtype=object)

    return decode(ids)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, ids: one row per document, without a shuffle."""
    return documents.select("doc_id", token_ids(F.col("text"), vocabulary_path(name, folder)).alias("ids"))


def round_trip(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, tokens, same: whether decoding gives the text back."""
    path = vocabulary_path(name, folder)
    d = documents.select("doc_id", "text", token_ids(F.col("text"), path).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("tokens"), (F.coalesce("text", F.lit("")) == decoded(F.col("ids"), path)).alias("same"))
