from __future__ import annotations

import random

import pytest

from finspark.llm import folding, overlap as O

IN = "document_id string, split string, content string, source_file string, h string, train int"


def sentence(rng):
    return f"{rng.choice('甲乙丙丁戊己庚辛')}{rng.choice('山水火木')}公司{rng.choice(['第一季度', '上半年', '全年'])}实现{rng.choice(['收入', '利润', '存货', '负债'])}{rng.randint(10, 99999)}万元，同比变动{rng.randint(1, 999) / 10}%。"


def corpus():
    rng, rows, want = random.Random(4), [], set()
    for i in range(60):
        s = [sentence(rng) for _ in range(10)]
        rows.append((f"t{i:03}", "train", "".join(s)))
        if i % 4 == 0:
            e = s[:]
            rng.shuffle(e)
            e[0] = e[0].replace("万元", "亿元")
            e[1] = sentence(rng)
            rows.append((f"e{i:03}", "eval" if i % 8 else "holdout", "\n".join(e).replace("，", ", ").replace("%", "％")))
            want.add((f"e{i:03}", f"t{i:03}"))
        if i % 4 == 1:
            rows.append((f"e{i:03}", "eval", "".join(s[:5] + [sentence(rng) for _ in range(5)])))
        if i % 10 == 3:
            rows.append((f"x{i:03}", "eval", rows[-1][2] if rows[-1][0][0] == "t" else "".join(s)))
            want.add((f"t{i:03}", f"x{i:03}"))
    return rows, want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "clash", 1) for r in rows], IN)


def test_planted_pairs_and_brute_force(spark):
    rows, want = corpus()
    got = {tuple(r) for r in O.split_overlaps(frame(spark, rows)).collect()}
    assert got == want
    brute = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[1] == "train" != b[1] and O.agreement(a[2], b[2]) >= O.AGREE}
    assert brute == want
    report = {(r.split, r.overlapping) for r in O.overlap_report(frame(spark, rows)).collect()}
    assert sum(n for s, n in report if s == "train") == len(want)


def test_copies_lose_no_link(spark):
    rng = random.Random(1)
    text = "".join(sentence(rng) for _ in range(8))
    rows = [(f"t{i}", "train", text) for i in range(40)] + [(f"e{i}", "eval", text + "\n") for i in range(7)]
    assert O.split_overlaps(frame(spark, rows)).count() == 280


@pytest.mark.parametrize("content", [None, "", "  \n", "。。", "🙂"])
def test_odd_input(spark, content):
    rows = [("a", "train", content), ("b", "eval", content), ("c", None, "正文内容一样。"), (None, "eval", "正文内容一样。"), ("d", "train", "正文内容一样。"), ("d", "train", "正文内容一样。"), ("e", "eval", "正文内容一样。")]
    assert [tuple(r) for r in O.split_overlaps(frame(spark, rows)).collect()] == [("d", "e")]
    assert O.split_overlaps(frame(spark, rows).limit(0)).count() == 0


def edited(rng, s, n):
    """A sentence with n characters changed, taken out or put in, anywhere."""
    for _ in range(n):
        i = rng.randrange(len(s) - 1)
        s = rng.choice([s[:i] + "变" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "添" + s[i:]])
    return s


def test_no_link_is_lost_to_edits(spark):
    """Every sentence edited as far as the definition allows, at every length; found pairs equal brute force."""
    rng, rows = random.Random(9), []
    letters = "营业收入利润存货负债现金流量净额同比增长下降山水火木金土甲乙丙丁戊己庚辛壬癸"
    for i in range(120):
        s = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 70))) + "。" for _ in range(rng.randint(1, 9))]
        e = [edited(rng, x, rng.choice([0, O.edits_allowed(len(x) - 1), O.edits_allowed(len(x) - 1)])) for x in s]
        rng.shuffle(e)
        rows += [(f"t{i:03}", "train", "".join(s)), (f"e{i:03}", "eval", "".join(e))]
    got = {tuple(r) for r in O.split_overlaps(frame(spark, rows)).collect()}
    brute = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[1] == "train" != b[1] and O.agreement(a[2], b[2]) >= O.AGREE}
    assert got == brute and len(got) > 100


def test_short_sentences_beside_a_long_one(spark):
    """Four short equal sentences and a long one of another text: four fifths of the sentences, little of the text."""
    short = ["收入有所增长。", "利润有所下降。", "存货保持平稳。", "负债率为三成。"]
    rows = [("t", "train", "".join(short) + "甲" * 60 + "乙丙" * 40 + "。"), ("e", "eval", "丁戊己" * 40 + "。" + "".join(short[::-1])), ("f", "eval", "".join(short[:3]) + "庚辛。壬癸子。")]
    assert [tuple(r) for r in O.split_overlaps(frame(spark, rows)).collect()] == [("e", "t")]


def test_hot_sentences_meet_no_one(spark):
    """A sentence of every text is in no prefix of a text that has rarer ones."""
    rng = random.Random(6)
    rows = [(f"{side[0]}{i}", side, "本文不构成投资建议，请阅读完整的免责声明后再作决定。" + "".join(sentence(rng) for _ in range(9))) for i in range(50) for side in ("train", "eval")]
    texts = O.read_sentences(frame(spark, rows)).selectExpr("c", "c2", "s", "train", "not train held")
    hot = O._index(texts).groupBy("c").count().count()
    assert hot == 50 and O._index(texts).where("n = 25").count() == 0
    assert O.split_overlaps(frame(spark, rows)).count() == 0


def test_operator_without_table(spark):
    rows = [("t", "train", "收入增长百分之三，毛利率改善。"), ("e", "eval", "收入增长百分之三，毛利率改善。")]
    assert O.split_overlaps(frame(spark, rows)).count() == 1


def test_long_text():
    rng = random.Random(2)
    t = "".join(sentence(rng) for _ in range(5000))
    assert O.agreement(t, t) == 1.0


def test_edit_distance():
    assert folding.edit_distance("kitten", "sitting", 5) == 3 and folding.edit_distance("abc", "abc", 0) == 0 and folding.edit_distance("abc", "xyz", 1) == 2
