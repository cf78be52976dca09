from __future__ import annotations

from finspark.llm import scans as S

OCR = "line_key long, doc_id string, run_id string, page int, line_no int, text string, furniture string"
BLOCK = "block_key long, doc_id string, run_id string, page int, block_order int, level string, text string"
WORDS = "the margin of the segment recovered while management expected further growth in materials and machine tools this year".split()


def corpus(spark):
    """Pages with a running head, page numbers, two split words and misread words planted in repeated prose."""
    rows, want, key = [], set(), 0
    for d in range(6):
        for p in range(1, 6):
            page = [f"Company {d} | Equity Research"]
            page += [" ".join(WORDS[(i + p) % 5 :]) + "." for i in range(6)] + ["公司营业收入增长，未来一年资本开支约3亿元。"] * 3
            page += ["The longer-term contract is a joint-venture asset in this year.", "management of the seg-", "ment recovered in the longer-", "term contract."]
            if p == 3:
                page[4:4] = ["the rnargin of the segmcnt recovered", "公司菅业收入增长，未来一年资本开支约3亿元。", "约S3亿元"]
            page += [f"Page {p} of 5"]
            for n, t in enumerate(page):
                key += 1
                rows.append((key, f"d{d}", "r", p, n, t, "clash"))
                if n in (0, len(page) - 1):
                    want.add((key, "furniture"))
                if t.endswith("seg-"):
                    want.add((key, "split_word"))
                if "rnargin" in t or "菅" in t or "S3" in t:
                    want.add((key, "misread"))
    return spark.createDataFrame(rows, OCR), want


def test_planted_defects(spark):
    ocr, want = corpus(spark)
    none = spark.createDataFrame([], BLOCK)
    got = {(r.record_key, r.defect) for r in S.defects(ocr, none).collect()}
    assert got == want
    text = " ".join(r.text for r in S.paragraphs(ocr, none).collect())
    assert "segment recovered in the longer-term contract." in text and "rnargin" not in text and "Page 3" not in text and "菅" not in text and "约53亿元" in text


def test_paragraphs_of_blocks(spark):
    """Pages that stand only in scanned blocks come out as paragraphs too, repaired alike, each with its place."""
    ocr, _ = corpus(spark)
    F = S.F
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda y: y["text"]), "\n").alias("text")
    blocks = ocr.groupBy("doc_id", "run_id", "page").agg(F.min("line_key").alias("block_key"), page)
    blocks = blocks.select("block_key", "doc_id", "run_id", "page", F.lit(1).alias("block_order"), F.lit("ocr").alias("level"), "text")
    clean = spark.createDataFrame([(10**6, "d0", "r", 1, 2, "body", "Clean text of a native page.")], BLOCK)
    only = {tuple(r) for r in S.paragraphs(spark.createDataFrame([], OCR), blocks.unionAll(clean)).select("doc_id", "run_id", "start_page", "text").collect()}
    alone = S.paragraphs(ocr, blocks.limit(0)).select("doc_id", "run_id", "start_page", "text").collect()
    assert alone and only == {tuple(r) for r in alone}
    key = {(r.doc_id, r.page): r.block_key for r in blocks.collect()}
    both = S.paragraphs(ocr, blocks).collect()
    fields = [[r for r in both if r.field_name == f] for f in ("ocr_lines.text", "blocks.text")]
    assert len(fields[0]) == len(fields[1]) == len(alone) and len(both) == 2 * len(alone)
    assert all(r.record_key == key[r.doc_id, r.start_page] and r.start_line >= 1 for r in fields[1])


def test_rows_delivered_twice_give_a_paragraph_once(spark):
    rows = [(1, "d", None, 1, None, "The body of the page goes on", ""), (1, "d", None, 1, None, "The body of the page goes on", ""), (None, "e", "r", 2, 3, "A line without a key.", "")]
    got = sorted(((r.doc_id, r.run_id, r.start_page, r.start_line, r.record_key) for r in S.paragraphs(spark.createDataFrame(rows, OCR), spark.createDataFrame([], BLOCK)).collect()), key=str)
    assert got == [("d", None, 1, None, 1), ("e", "r", 2, 3, None)]


def test_decisions_are_joined_alike_at_every_size(spark):
    """The places meet the decisions in a join; without any broadcast the result is the same."""
    ocr, want = corpus(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {(r.record_key, r.defect) for r in S.defects(ocr, spark.createDataFrame([], BLOCK)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want


def test_without_recurrence_nothing_is_found(spark, monkeypatch):
    """Counts decide: where no form is frequent enough, neither digits nor page marks nor words are defects of their own."""
    ocr, want = corpus(spark)
    monkeypatch.setattr(S, "AT_LEAST", 10**6)
    got = {(r.record_key, r.defect) for r in S.defects(ocr, spark.createDataFrame([], BLOCK)).collect()}
    assert {x for x in got if x[1] == "misread"} == set() and {x for x in want if x[1] == "furniture"} <= got
    one = ocr.where("doc_id = 'd0' and page = 2")
    assert S.defects(one, spark.createDataFrame([], BLOCK)).where("defect = 'furniture'").count() == 0


def test_long_running_heads(spark):
    head = "Annual report of the company and of its subsidiaries for the year ended on the 31st of December "
    rows = [(10 * d + p + i * 1000, f"d{d}", "r", p, i, t, "") for d in range(4) for p in range(1, 5) for i, t in enumerate([(head + str(2020 + d))[:60], f"Body text {d} {p} of the page, alone.", "The end of it."])]
    got = {r.record_key for r in S.defects(spark.createDataFrame(rows, OCR), spark.createDataFrame([], BLOCK)).where("defect = 'furniture'").collect()}
    assert got >= {r[0] for r in rows if r[4] == 0}


def test_blocks_and_odd_input(spark):
    blocks = spark.createDataFrame([(1, "d", "r", 1, 1, "ocr", "一行\n\n二行"), (2, "d", "r", 1, 2, "body", "三行-\n四"), (3, None, None, None, None, "ocr", None), (4, None, None, None, None, "ocr", ""), (5, None, None, None, None, "ocr", "孤行")], BLOCK)
    none = spark.createDataFrame([], OCR)
    assert S.defects(none, blocks).count() == 0 and S.defects(none, blocks.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "d", None, 1, None, "x" * 50_000, ""), (2, "d", None, 1, None, "x" * 50_000, "")], OCR)
    assert S.defects(odd, blocks).count() == 0
    assert S.paragraphs(odd, blocks).count() >= 1


def test_pieces(spark):
    assert S.word_skeleton("rnargin") == S.word_skeleton("margin") and S.word_skeleton("produchon") == S.word_skeleton("production") and S.word_skeleton("biIlion") == S.word_skeleton("billion")
    values = {"- 20 -": 20, "iv": 4, "1O": 10, "2.1": None, "第 8 页 共 11 页": 8, "Page 1 of 7": 1, "~25~": 25, "l": None, "2021 2022 2023": None, "lxxxix": 89}
    got = {r.t: r.v for r in spark.createDataFrame([(k,) for k in values], "t string").select("t", S.page_value(S.F.col("t")).alias("v")).collect()}
    assert {k: v for k, v in got.items() if k != "2.1"} == {k: v for k, v in values.items() if k != "2.1"}
    forms = [r.f for r in spark.createDataFrame([("Annual Report 2O21  12",), ("Annua1 Repcrt 2022 7",), ("证券研究报告｜甲",)], "t string").select(S.furniture_form(S.F.col("t")).alias("f")).collect()]
    assert forms[0].split(" ")[0] == forms[1].split(" ")[0] and forms[0].endswith("#")


def test_triples_are_exact():
    text = "\n公司菅业收入约1O3亿元\n"
    places, packed = S._triples(text)
    assert [text[p] for p in places] == [c for i, c in enumerate(text) if c in S.GLYPH or c.isdigit() or i in S._letters_in_numbers(text)]
    assert all(int(t) >> 42 < 0x110000 and (int(t) >> 21) & 0x1FFFFF in {ord("#"), *map(ord, text)} for t in packed)
