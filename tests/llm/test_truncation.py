from __future__ import annotations

import random

import pytest

from finspark.llm import truncation as T

KNOWN = T.Known(closings={"以上", "Verdict: needs review", "And so on", "其余从略"}, keys={"$.errors[]": frozenset({"error_type", "reason"})})


@pytest.mark.parametrize(
    "text,want",
    [
        (None, False), ("", False), ("  \n", False), ("ok", False), ("[REDACTED]", False), ("收入增长。", False), ("本期收入较上年同期大幅增长", True), ("收入增长", False), ("It rose by 4.3%.", False), ("The revenue rose by 4", True), ("It rose by 4.", True), ("in 2024.", False),
        ("已核对。以上", True), ("已核对。\n以上", False), ("已核对。\nVerdict: needs review", False), ("已核对。\nVerdict: nee", True), ("已核对。\n- 毛利率：18.2%", False), ("已核对。 And so on...", False), ("已核对。其余从略……", False),
        ("已核对。收入写作...", True), ("已核对。收入…", True), ("已核对。收�", True), ("已核对。剔 (cont", True), ("已核对。\n[output limit reached]", False), ("已核对。拓\n[output limit reached]", True),
        ('{"errors": []}', False), ('```json\n{"errors": []}\n```', False), ('```json\n{"errors": []}', False), ('{"errors": [{"error_type": "a", "reason": "b"},]}', False), ('{"errors": [{"error_type": "a", "rea', True),
        ('{"errors": [{"error_type": "a"}]}', True), ('{"errors": [{"err"}]}]}', True), ('{"errors": [{"error_type": "a", "reason": "b"}]}]}', True), ('注：{"errors": [{"error_type": "指', True), ("| 营业收入 | 12.4 |", False),
    ],
)
def test_ends(text, want):
    assert T.is_cut(text, False, KNOWN) is want


def test_spikes_and_flags_over_a_corpus(spark):
    rng = random.Random(5)
    sentence = "公司收入增长百分之{}，毛利率有所改善。"
    rows, cut = [], set()
    for i in range(400):
        t = "".join(sentence.format(rng.randint(1, 999)) for _ in range(rng.randint(2, 30)))
        if len(t) > 300:
            t = t[:300]
            if t[-1] != "。":
                cut.add(str(i))
        rows.append(("f", str(i), "s", t))
    rows += [("f", "n", None, None), ("f", "e", "s", ""), ("f", "e", "s", "")]
    df = spark.createDataFrame(rows, "field_name string, record_id string, source string, text string")
    assert ("f", "s", "chars", 300) in {tuple(r)[:4] for r in T.length_spikes(df).collect()}
    got = {r.record_id for r in T.mark_cut(df).where("cut").collect()}
    assert got == cut
    assert T.mark_cut(df).count() == len(rows)
    assert T.mark_cut(df.limit(0)).count() == 0


def test_tables(spark):
    m = spark.createDataFrame([("a", "s", "本期收入，较上年同期大幅增", 1), ("b", None, None, 2)], "response_key string, source string, content string, text int")
    r = spark.createDataFrame([("c", "s", "收入增长。")], "request_id string, source string, last_message string")
    assert {tuple(x) for x in T.cut_records(m, r).collect()} == {("model_responses.content", "a")}
    assert {(x.field_name, x.source, x.records, x.cut) for x in T.cut_share(m, r).collect()} == {("model_responses.content", "s", 1, 1), ("model_responses.content", None, 1, 0), ("run_results.last_message", "s", 1, 0)}


def test_long_text():
    assert T.is_cut("收入增长。" * 100_000, False, KNOWN) is False
    assert T.is_cut('{"errors": [' * 5_000, False, KNOWN) is True
