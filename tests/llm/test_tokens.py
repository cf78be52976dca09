from __future__ import annotations

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from finspark.llm import tokens as K

PATH = K.vocabulary_path()
E = K.encoder(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_like_the_public_tokenizer(text):
    ids = E.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    d = K.Decoder(E.v)
    assert d.feed(ids) + d.finish() == text


def test_pieces_of_any_size():
    rng = random.Random(3)
    data = "".join(rng.choice("第三季度营业收入abcdefüé") for _ in range(9000)).encode()
    t, out, i = K.Transducer(E.v), [], 0
    while i < len(data):
        k = rng.randint(1, 900)
        out += t.feed(data[i : i + k])
        assert len(t.data) <= t.keeps
        i += k
    assert out + t.finish() == E.v.merge(data[:0]) + REFERENCE._encode_single_piece(data)


@given(st.binary(max_size=60))
@settings(max_examples=200, deadline=None)
def test_decoder_replaces_like_utf8(data):
    d = K.Decoder(E.v)
    got = d.feed([E.v.ranks[bytes([b])] for b in data]) + d.finish()
    assert got == data.decode("utf-8", "replace")


@pytest.mark.parametrize("text,want", [(None, []), ("", []), (" ", [220]), ("<|endoftext|>", REFERENCE.encode_ordinary("<|endoftext|>"))])
def test_odd_texts(text, want):
    assert E.encode(text) == want


def test_documents(spark):
    docs = spark.createDataFrame([(1, "收入增长"), (1, "收入增长"), (2, None), (3, ""), (4, "x" * 30_000)], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {(r.doc_id, len(r.ids)) for r in K.encode_documents(docs).collect()}
    assert got == {(1, len(REFERENCE.encode_ordinary("收入增长"))), (2, 0), (3, 0), (4, len(REFERENCE.encode_ordinary("x" * 30_000)))}
    assert K.encode_documents(docs.limit(0)).count() == 0
    assert all(r.same for r in K.round_trip(docs).collect())


def test_tokens_are_emitted_before_the_end():
    """What feed gives is final, most of it comes before finish, and memory is bounded by the lookahead."""
    rng = random.Random(8)
    data = "".join(rng.choice(["营业收入", "revenue", "同比增长", " quarter", "12"]) for _ in range(3000)).encode()
    t, out = K.Transducer(E.v), []
    for b in data:
        out += t.feed(bytes([b]))
        assert len(t.data) <= t.keeps
    early = len(out)
    out += t.finish()
    assert out == REFERENCE._encode_single_piece(data) and early > 0.95 * len(out)


def test_without_stable_boundaries_nothing_is_emitted(monkeypatch):
    monkeypatch.setattr(K.Transducer, "_stable", lambda self: 0)
    t = K.Transducer(E.v)
    data = "营业收入同比增长".encode() * 200
    assert t.feed(data) == [] and len(t.data) == len(data) > t.keeps
    assert t.finish() == REFERENCE._encode_single_piece(data)


def test_texts_go_through_the_transducer(monkeypatch):
    e, seen = K.Encoder(E.v), []
    feed = K.Transducer.feed
    monkeypatch.setattr(K.Transducer, "feed", lambda self, x: seen.append(x) or feed(self, x))
    text = "收入增长 and the margin of a segment 12%。"
    assert e.encode(text) == REFERENCE.encode_ordinary(text) and b"".join(seen) == text.encode()


def test_lookahead_suffices():
    """Nothing appended behind the lookahead changes a boundary before it."""
    rng = random.Random(5)
    for _ in range(40):
        x = "".join(rng.choice("第三季度营业收入abcdefgh 12") for _ in range(700)).encode()
        y = bytes(rng.randrange(256) for _ in range(50))
        a, b = REFERENCE._encode_single_piece(x), REFERENCE._encode_single_piece(x + y)
        at, k = 0, 0
        while at + len(E.v.bytes[a[k]]) <= len(x) - E.v.lookahead:
            at += len(E.v.bytes[a[k]])
            assert a[k] == b[k]
            k += 1
