"""Queries that read every text, span and row whole, on fixtures that a cut would change."""

from __future__ import annotations

import math
import re
from collections import Counter
from decimal import Decimal

from finspark.plans import catalogue
from finspark.session import table

QUERIES = catalogue.queries()


def _terms(text: str) -> list[str]:
    runs = re.findall("[一-鿿]+", text.lower())
    return re.findall("[a-z0-9]+", text.lower()) + [c for r in runs for c in r] + [r[i : i + 2] for r in runs for i in range(len(r) - 1)]


def test_ranking_asks_with_the_whole_text(spark, tmp_path):
    docs = [(1, "alpha alpha beta"), (2, "库存周转 gamma"), (3, "gamma delta 存货"), (4, None), (5, "")]
    items = [(0, "alpha " * 8 + "库存周转 gamma"), (20, "x" * 41 + " delta 存货"), (40, None), (41, "alpha")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    bags = {d: Counter(_terms(t)) for d, t in docs if t is not None}
    mean, want = sum(sum(b.values()) for b in bags.values()) / len(bags), {}
    for q, text in items:
        if q % 20 or text is None:
            continue
        for d, b in bags.items():
            s = 0.0
            for t in set(_terms(text)) & set(b):
                df = sum(t in x for x in bags.values())
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean))
            if s > 0:
                want[q, d] = round(s, 4)
    got = {(r.query_id, r.doc_id): float(r.score) for r in QUERIES["bm25_topk_whole"](spark, str(tmp_path)).collect()}
    assert got == want and {(0, 2), (20, 3)} <= set(got)


_CASES = "case_id string, document_id string, gold struct<spans array<struct<span_start int, span_end int, original_text string, text string>>>"


def test_every_span_of_a_case(spark, tmp_path):
    spans = {
        "two": [(1, 3, "bc", "XYZ"), (5, 6, "f", "")],
        "unordered": [(7, 8, "h", "88"), (0, 1, "a", "é🙂")],
        "touching": [(2, 4, "cd", "1"), (4, 6, "ef", "2")],
        "inserted": [(4, 4, "", "+"), (4, 6, "ef", "2"), (4, 4, "", "-")],
        "crossed": [(1, 4, "bcd", "x"), (3, 6, "def", "y")],
        "within": [(0, 8, "abcdefgh", "x"), (2, 3, "c", "y")],
        "beyond": [(0, 1, "a", "b"), (6, 99, "gh", "x")],
        "null": [(0, 1, "a", "b"), (2, 3, "c", None)],
        "none": [],
    }
    rows = [(k, "d", (v,)) for k, v in spans.items()] + [("lost", "e", ([(0, 1, "a", "b")],)), ("fp", "d", None)]
    spark.createDataFrame(rows, _CASES).write.parquet(f"{tmp_path}/case_evidence.parquet")
    spark.createDataFrame([("d", "abcdefgh"), ("e", None)], "document_id string, content string").write.parquet(f"{tmp_path}/inputs_research442.parquet")
    got = {r.case_id: (r.outcome, r.changed) for r in QUERIES["apply_edits_whole"](spark, str(tmp_path)).collect()}
    whole = {"two": "aXYZdegh", "unordered": "é🙂bcdefg88", "touching": "ab12gh", "inserted": "abcd-+2gh", "none": "abcdefgh"}
    assert got == {k: ("spliced", v) for k, v in whole.items()} | {"crossed": ("overlapping_spans", None), "within": ("overlapping_spans", None), "beyond": ("bad_span", None), "null": ("bad_span", None), "lost": ("no_content", None)}
    bags = {(r.case_id, r.span_index): None if r.agreement is None else float(r.agreement) for r in QUERIES["bag_agreement_whole"](spark, str(tmp_path)).collect()}
    assert len(bags) == sum(map(len, spans.values())) + 1
    for k, v in spans.items():
        for i, (_, _, a, b) in enumerate(v):
            m, n = Counter(b or ""), Counter(a)
            assert bags[k, i] == (None if b is None or not (m | n) else round(sum((m & n).values()) / sum((m | n).values()), 4))


def test_single_spans_are_spliced_as_before(spark):
    sf = "/root/testdata/sf0.001"
    whole = {r.case_id: r.changed for r in QUERIES["apply_edits_whole"](spark, sf).collect()}
    old = {r.case_id: r.changed for r in QUERIES["apply_edits"](spark, sf).collect()}
    assert old and all(whole[k] == v for k, v in old.items()) and len(whole) > len(old)


def test_every_printed_form_of_a_number(spark, tmp_path):
    shown = [("504,131,400,000", "元"), ("(1,234.5)", "万元"), ("１２３．４", "亿元"), ("1234567890123456789.25", "元"), ("3519183.4US$ thousand", None), ("-7", "万 元"), ("5亿元", "万元"), ("about 5", "元"), ("5", None), (None, "元"), ("12%", "%"), ("0.00", "千元"), ("-$8", "bp")]
    rows = [(i, v, u, *("abcdef"), ) for i, (v, u) in enumerate(shown)]
    rows += [(100 + i, v, u, "other", *"bcdef") for i, (v, u) in enumerate([("1,000", "万元"), ("1000.0", "万 元"), ("(1,000)", "万元"), ("2,000万元", None), ("1000", "亿元"), ("7", "unheard"), ("8", "unheard"), ("9", None), ("x", "万元")])]
    spark.createDataFrame(rows, "row_id long, value string, unit string, company string, metric string, period string, basis string, scope string, currency string").write.parquet(f"{tmp_path}/facts.parquet")
    got = {r.row_id: (r.value, r.unit) for r in QUERIES["quantity_normalize_whole"](spark, str(tmp_path)).collect() if r.row_id < 100}
    want = [("504131400000", "yuan"), ("-12345000", "yuan"), ("12340000000", "yuan"), ("1234567890123456789.25", "yuan"), ("3519183400", "dollar"), ("-70000", "yuan")] + [(None, None)] * 4 + [("12", "percent"), ("0", "yuan"), (None, None)]
    assert got == dict(enumerate(want))
    first = {r.row_id: r.v for r in QUERIES["lenient_number_whole"](spark, str(tmp_path)).collect() if r.row_id < 100}
    assert first == dict(enumerate(["504131400000", "1234.5", "123.4", "1234567890123456789.25", "3519183.4", "-7", "5", "5", "5", None, "12", "0", "-8"]))
    found = {r.company: (r.first_row, r.last_row, r.pairs) for r in QUERIES["intrinsic_conflict_findings_whole"](spark, str(tmp_path)).collect()}
    assert found["other"] == (100, 106, 5 + 1)
    assert found["a"] == (0, 5, 2) and len(found) == 2


def test_plain_numbers_are_read_as_before(spark):
    sf = "/root/testdata/sf0.01"
    new = {r.row_id: r for r in QUERIES["quantity_normalize_whole"](spark, sf).collect()}
    old = QUERIES["quantity_normalize"](spark, sf).collect()
    # the old one rounds to six decimals before it scales by 10**8 at most
    assert old and all(new[r.row_id].unit == "yuan" and abs(r.yuan - Decimal(new[r.row_id].value)) <= 50 for r in old)
    first = {r.row_id: r.v for r in QUERIES["lenient_number_whole"](spark, sf).collect()}
    # other minus signs, points and commas than the ASCII ones are lost in the old one
    ascii_ = {r.row_id for r in table(spark, sf, "facts").select("row_id", "value").collect() if r.value and r.value.isascii() and "$" not in r.value}
    both = [(r.v, Decimal(first[r.row_id])) for r in QUERIES["lenient_number"](spark, sf).collect() if r.row_id in ascii_]
    assert both and all(a == b for a, b in both)
    keys = lambda n: {tuple(r[:6]): r.pairs for r in QUERIES[n](spark, sf).collect()}
    old, new = keys("intrinsic_conflict_findings"), keys("intrinsic_conflict_findings_whole")
    assert old and all(new[k] >= n for k, n in old.items())


def test_every_document_is_split_and_tokenised(spark, tmp_path):
    docs = [(1, "收入增长。利润下降！\r\n"), (2, None), (3, ""), (4, " \r\n\t　"), (5, "a b?\rc d!\nB"), (6, "库存周转" * 30_000 + "。" + "x y! " * 20_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split = {r.doc_id: r.sentences for r in QUERIES["sentence_split_documents"](spark, str(tmp_path)).collect()}
    assert split == {1: 2, 2: None, 3: 0, 4: 0, 5: 3, 6: 20_001}
    got = {r.doc_id: (r.tokens, r.terms) for r in QUERIES["tokenize_bigrams_documents"](spark, str(tmp_path)).collect()}
    assert got == {d: (None, None) if t is None else (len(_terms(t)), len(set(_terms(t)))) for d, t in docs}
