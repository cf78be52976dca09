from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from finspark.llm import lookalikes as L

SPAN = "array<struct<anchor_method:string,span_start:int,span_end:int,original_start:int,original_text:string,text:string>>"
CASE = f"case_id string, document_id string, gold struct<id:string,spans:{SPAN}>"


OTHER = "\u200b\u00ad\u00a0\u3000\u0301ａｂｃ，．％éаеорсѕі−‑⽤用⻓长²①1xA-"


def rules(text):
    return L.Rewriter(L.build_rules(Counter(text * 9 + OTHER)))


def test_what_looks_the_same():
    r = rules("abcdefghijklmnopqrstuvwxyz,.% é-0123 ")
    assert r("ａｂｃ，．％") == r("abc,.%")
    assert r("é") == r("é") and r("е́") == r("é") and r("é") != r("e")
    assert r("a\u200bb\u00adc") == "abc" and r("a\u00a0b") == r("a\u3000b") == r("a b") and r("a  b") != r("a b")
    assert r("раssіon") == "passion" and r("1−2") == r("1-2") == r("1‑2")
    assert r("⽤") == r("用") and r("⻓") == r("长")
    assert r("x²") != r("x2") and r("①") != r("1") and r("A") != r("a") and r("o") != r("0")


def test_representative_is_the_most_frequent_and_rewriting_settles():
    r = L.Rewriter(L.build_rules({"а": 10, "a": 3, "b": 1}))
    assert r("a") == "а"
    for t in ("e​́x", "", "​", "ﬁ", "Ａ̊"):
        q = rules(t + "éåA")
        assert q(q(t)) == q(t)


def case(i, text, a, b, doc="d"):
    return (i, doc, ("g", [("m", a, b, a, text, text)]))


def test_spans(spark):
    cases = [case("1", "收入５％", 0, 4), case("2", "收入5%", 0, 4), case("3", "收入6%", 0, 4), case("4", None, 0, 4), case("5", "收入５％", None, 4), case("6", "x", 90, 95), ("7", "d", None), case("8", "收入５％", 0, 4, None), case("9", "收入５％", -3, 4)]
    c = spark.createDataFrame(cases, CASE).withColumn("text", F.lit("clash"))
    docs = spark.createDataFrame([("d", "收入5%增长"), ("d", "收入5%增长"), ("e", None), (None, "收入5%")], "document_id string, content string")
    assert [tuple(r) for r in L.spans_alike(c, docs).collect()] == [("1", 0)]
    assert L.spans_alike(c.limit(0), docs).count() == 0 and L.spans_alike(c, docs.limit(0)).count() == 0
    assert L.consistent_contents(c, docs).count() == 4


def test_long_text():
    r = rules("ａb" * 10)
    assert len(r("ａ" * 300_000)) == 300_000
