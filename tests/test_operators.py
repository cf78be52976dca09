"""Operators without SQL: against brute force, fixtures or invariants, and odd input."""

from __future__ import annotations

import gzip
import io
import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from finspark.operators import detectors, graph, layout, lexical, matching, texts, vectors
from finspark.sources import readers, writers
from finspark.streaming import windows


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(f"i{rng.randint(0, 80):02}", f"k{rng.randint(0, 70)}") for _ in range(90)] + [(f"i{n:02}", "hot") for n in range(30)] + [(None, "k1"), ("i1", None)]
    edges += [(f"p{n:03}", f"c{n}") for n in range(60)] + [(f"p{n:03}", f"c{n + 1}") for n in range(60)]
    got = {r.item: r.component for r in graph.components(spark.createDataFrame(edges, "item string, key string")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, k in edges:
        if i and k:
            a, b = find(i), find("~" + k)
            up[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i, k in edges if i and k}
    assert graph.components(spark.createDataFrame([], "item string, key string")).count() == 0


def _brute(edges):
    for size in range(len(edges), 0, -1):
        for c in itertools.combinations(edges, size):
            if len({a for a, _ in c}) == size == len({b for _, b in c}):
                return size
    return 0


def test_matching_is_maximum(spark):
    rng = random.Random(1)
    for _ in range(150):
        e = list({(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(rng.randint(0, 8))})
        assert matching.maximum_matching(e) == _brute(e)
    df = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 2, 1), ("e", 1, None), ("f", 1, 1)], "doc string, p int, g int")
    assert {tuple(r) for r in matching.matched_counts(df, "doc", "p", "g").collect()} == {("d", 2), ("f", 1)}


def test_cosine_in_passes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(100)] + [(200, None), (220, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once = {tuple(r) for r in vectors.cosine_topk(df, 3).collect()}
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 2)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert {tuple(r) for r in vectors.cosine_topk(df, 3).collect()} == once and len(once) == 15
    assert vectors.cosine_topk(df.limit(0)).count() == 0


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "收入增长"), (2, None), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "收入"), (2, None), (3, "zzz")], "query_id long, text string")
    assert [r.doc_id for r in lexical.bm25_topk(docs, q).collect()] == [1]


@pytest.mark.parametrize("seed", range(5))
def test_reading_order_is_a_permutation(seed):
    rng = random.Random(seed)
    boxes = [(x := rng.randint(0, 400), y := rng.randint(0, 700), x + rng.randint(5, 150), y + rng.randint(5, 40)) for _ in range(rng.randint(0, 30))]
    assert sorted(layout.xy_order(boxes)) == list(range(len(boxes)))


def test_two_columns():
    boxes = [(300, 100, 500, 200), (50, 100, 250, 200), (50, 20, 500, 60), (50, 210, 250, 300), (300, 205, 500, 300)]
    assert layout.xy_order(boxes)[0] == 2 and layout.xy_order(boxes).index(1) < layout.xy_order(boxes).index(0)


CASES = [
    ("2023年2月30日披露。", "calendar"), ("3月5日至3月1日停产。", "reversed_date_range"), ("2024年至2021年下降。", "backward_years"), ("合计1.5+2.5=5.0万元。", "arithmetic"), ("1.25*2=2.5", None), ("约1+1=3", None), ("1+2+3=5", None),
    ("得益于高端高端纸品。", "redundant_phrase"), ("见附注（）。", "empty_placeholder"), ("收入增长，。", "suspended_punctuation"), ("同比增长%。", "percent_gap"), ("全国30家公司中第45名。", "rank_within_total"),
    ("收入、利润、存货分别为1、2。", "enumeration"), ("收入、利润分别为1、2。", None), ("某某股份（6001）公告。", "stock_code_gap"), ("毛利率为35万元。", "unit_dimension"), ("2023年2月28日披露。", None),
]


def test_detectors(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(CASES)] + [("n", None), ("e", ""), ("c", "例如2023年2月30日。"), ("r", "同样的句子在这里。同样的句子在这里。同样的句子在这里。")], "id string, text string")
    got = {(r.document_id, r.detector): r.status for r in detectors.detect(df, "id", "text").collect()}
    want = {(str(i), d): "confirmed" for i, (_, d) in enumerate(CASES) if d} | {("c", "calendar"): "needs_review", ("r", "redundant_sentence"): "confirmed"}
    assert got == want


def test_windows_and_chunks(spark):
    rng = random.Random(4)
    for _ in range(100):
        t = "".join(rng.choice("收入ab \n。.") for _ in range(rng.randint(0, 300)))
        w = texts.token_windows(t, 20)
        assert {i for s, e in w for i in range(s, e)} == set(range(len(t))) and all(a[0] < b[0] for a, b in zip(w, w[1:]))
        assert all(texts.estimated_tokens(t[s:e]) <= 20 for s, e in w)
        c = texts.chunk(t, 50)
        assert all(len(x) <= 50 for x in c)
    assert texts.token_windows(None, 5) == [] and texts.chunk(None) == []
    got = spark.createDataFrame([("收入3万元和45",)], "t string").lateralJoin(texts.RegexSpans(F.col("t").outer(), F.lit(r"\d+"))).select("span_start", "span_end", "text")
    assert [tuple(r) for r in got.collect()] == [(2, 3, "3"), (6, 8, "45")]
    e = texts.edit_spans("收入3万元", "收入5亿元")
    assert "".join(("收入3万元"[:2], e[0][2])) == "收入5亿"
    assert texts.greedy_cover(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("c", 1)], "i string, k int"), "i", "k", 5) == [("b", 3), ("a", 1)]
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 1',), ("x",), (None,)], "t string").select(texts.recovered_json("t").alias("v")).collect()
    assert [r.v for r in j] == ['{"a": 1}', '{"a": 1}', None, None]


def test_sources_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "a.jsonl.gz"), "a int").orderBy("a").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="no object"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "r.json").write_text(json.dumps({"doc_id": "d", "run_id": "r", "pages": [{"page": 1, "status": "ok", "blocks": [{"block_id": "b", "type": "text", "text": "t", "bbox": [0, 0, 1, 1]}]}, {"page": 2, "status": "fail", "blocks": []}]}))
    assert [(r.page, r.text) for r in readers.parse_results(spark, str(tmp_path / "r.json")).collect()] == [(1, "t")]
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>一</w:t><w:tab/><w:t>二</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.docx").write_bytes(word.getvalue())
    (tmp_path / "w" / "b.docx").write_bytes(b"no zip")
    assert {(r.text, r.issue) for r in readers.word_paragraphs(spark, str(tmp_path / "w")).collect()} == {("一\t二", None), (None, "BadZipFile")}
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>收入</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>3.5</v></c><c r="C2"/></row></sheetData></worksheet>')
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xlsx").write_bytes(book.getvalue())
    assert {(r.row_no, r.cell, r.text) for r in readers.sheet_cells(spark, str(tmp_path / "x")).collect()} == {(2, "A2", "收入"), (2, "B2", "3.5")}
    html = spark.createDataFrame([("<table><tr><td>a</td><th> <b>b</b></th></tr><tr></tr></table>",)], "h string").select(readers.html_cells(F.col("h")).alias("c")).first().c
    assert html == [["a", "b"], []]
    path = writers.write_run(spark.createDataFrame([(1, "=x")], "a int, b string"), str(tmp_path), "r1")
    m = writers.manifest(spark, path)
    saved = spark.createDataFrame(m.collect(), m.schema)
    assert writers.verify(spark, path, saved).count() == 0
    assert {r.state for r in writers.verify(spark, path, saved.withColumn("sha256", F.lit("0"))).collect()} == {"changed"}
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_run(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path), "r1")
    assert writers.guarded(spark.createDataFrame([("=x", 1), ("y", 2), (None, 3)], "b string, n int")).orderBy("n").first().b == "'=x"
    for _ in range(2):
        writers.append_log(spark.createDataFrame([(1,)], "a int"), str(tmp_path), "access")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    for name, build in (("tumbling", lambda e: windows.tumbling(e, late="1000 days")), ("sliding", lambda e: windows.sliding(e, late="1000 days"))):
        q = build(windows.events_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(str, spark.table(name).collect()))
        assert got == sorted(map(str, build(events).collect())) and got
    q = windows.first_deliveries(windows.events_stream(spark, str(tmp_path / "in"), 1), "1000 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "conce")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == events.select("event_id").distinct().count()
