from __future__ import annotations

import random

from finspark.llm import leakage as L

ITEMS = [
    (1, "甲坞控股的第二大股东垫付了6115万股流通凭证由4名见证人画押，因独立董事两度缺席而失去追索权，磅单列有两种说法。甲坞工厂转让了9间沿街铺面且未附清单，因印章外借而沿用旧价，留底联却写作5979。市场有风险，决策需谨慎。"),
    (2, "乙渚股份及其联营方公示了3间沿街铺面并附168页底稿，因霜冻封路而失去追索权，交接清单标注待查。乙渚工厂撤回了6648件图纸副本并转交档案馆，因霜冻封路而退还押金4093元，公告注明以原件为准。市场有风险，决策需谨慎。"),
    (3, "A consortium steered by Quorrow catalogued 4087 certificates valued at 18.75 million because the translation skipped a row, though the list carries 26 signatures. The board of Quorrow relet 8 shops for the ferry upgrade once the slip expired."),
    (4, None), (5, ""),
]


def test_search_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(60))
        pats = {"".join(rng.choice("abc") for _ in range(5)): [] for _ in range(6)}
        pats |= {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): [] for _ in range(3)}
        got = sorted(L.WuManber(pats, 2).find(text))
        assert got == sorted((i, p) for p in pats for i in range(len(text)) if text.startswith(p, i))


def test_carried(spark):
    s1 = ITEMS[0][1].split("。")
    docs = [
        (1, "背景。" + s1[0].replace("因", "由于").replace("，", ", ") + "。其他。\n" + s1[1] + "。"), (2, s1[0][:20] + "。别的内容。市场有风险，决策需谨慎。"), (3, "丙渚股份及其联营方公示了7间沿街铺面并附99页底稿，因译本漏行而改走旧线，交接清单并未载明。" * 3),
        (4, ITEMS[2][1].upper().replace(" ", "\n")), (5, None), (6, ""), (7, "长" * 100_000 + ITEMS[1][1]), (8, s1[0] + "。"),
    ]
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as share")
    i = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'test' as split", "1 as doc_id")
    got = {tuple(r) for r in L.leaked_pairs(i, d).collect()}
    assert got == {(1, 1), (3, 4), (2, 7), (1, 8)}
    assert {(r.item_id, r.documents) for r in L.leaked_items(i, d).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert L.leaked_pairs(i.limit(0), d).count() == 0 and L.leaked_pairs(i, d.limit(0)).count() == 0


def test_passes_change_nothing(spark, monkeypatch):
    """A closing line that items of several passes share identifies none of them, in whatever passes they go out."""
    d = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "本报告的结论以原件为准，转载须经许可并注明出处和日期。")], "doc_id long, text string")
    closing = "本报告的结论以原件为准，转载须经许可并注明出处和日期。"
    i = spark.createDataFrame([(k, t and t + closing) for k, t in ITEMS] + [(7, "短句一句。" + closing)], "item_id long, text string")
    once = {tuple(r) for r in L.leaked_pairs(i, d).collect()}
    monkeypatch.setattr(L, "CHARS_PER_PASS", 60)
    assert {tuple(r) for r in L.leaked_pairs(i, d).collect()} == once == {(1, 1), (2, 2)}


def test_short_sentences_and_repeated_ids(spark):
    text = "收入增长。利润下降。存货平稳。负债偏高。"
    i = spark.createDataFrame([(1, text), (2, "别的内容在这里。另外一个句子。"), (2, ITEMS[0][1])], "item_id long, text string")
    d = spark.createDataFrame([(1, text), (2, "收入增长。其他。"), (3, ITEMS[0][1]), (4, "别的内容在这里。另外一个句子。")], "doc_id long, text string")
    assert {tuple(r) for r in L.leaked_pairs(i, d).collect()} == {(1, 1), (2, 3), (2, 4)}


def test_every_place_is_compared():
    """A passage that is reworded a little behind many places of like build."""
    s = "甲坞工厂转让了九间沿街铺面且未附清单，因印章外借而沿用旧价，留底联却写作五九七九元整。"
    like = s[:14] + "并" + s[15:24] + "另行商议其他条件后再行公告" * 2 + "。"
    items = L.Items([(1, [s])])
    real = s.replace("沿用", "改用")
    assert items.carried("。".join([like] * 9) + "。" + real) == {1: 1.0}
    assert items.carried("。".join([like] * 9)) == {}


def test_sentences_that_items_share_count_for_each(spark):
    """Only closing lines of unlike items identify none of them; one text under two ids, or a shared passage, leaks with both."""
    closing = "市场有风险，决策需谨慎。"
    a, b = ITEMS[0][1].removesuffix(closing), ITEMS[1][1].removesuffix(closing)
    first, second = a.split("。")[0] + "。", a.split("。")[1] + "。"
    other = "丁港船务的货运代表续签了七份泊位协议，条款仍照往年执行。"
    texts = [(1, a + closing), (2, a + closing), (3, b + closing), (4, first + other), (5, other + second), (6, second), (7, closing)]
    docs = [(1, a), (2, "其他。" + closing), (3, b + closing), (4, second), (5, other)]
    i, d = spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(k, 1) for k in (1, 2, 4, 5, 6)} | {(3, 3), (1, 4), (2, 4), (5, 4), (6, 4), (5, 5)}
    got = {tuple(r) for r in L.leaked_pairs(i, d).collect()}
    share = {(r.item_id, r.doc_id): r.share for r in L.leaks(i, d).collect()}
    assert got == want and share[1, 1] == share[2, 1] == 1
    assert {r.s for r in L.own_sentences(i).selectExpr("explode(own) s").collect()} >= {L.folding.bare(x) for x in (first, second, other)}


def test_an_edited_copy_of_an_item_keeps_its_ending(spark):
    parts = [ITEMS[0][1].split("。")[k] + "。" for k in (0, 1)] + [ITEMS[1][1].split("。")[k] + "。" for k in (0, 1)]
    texts = [(1, "".join(parts)), (2, "改写的开头在此。" + "".join(parts[1:])), (3, parts[0] + "改写的中段在此。" + parts[3])]
    own = {r.item_id: r.own for r in L.own_sentences(spark.createDataFrame(texts, "item_id long, text string")).collect()}
    assert [len(own[k]) for k in (1, 2, 3)] == [4, 4, 3]
