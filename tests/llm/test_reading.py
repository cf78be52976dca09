from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from finspark.llm import reading as R
from finspark.session import table

SF = "/root/testdata/sf0.01"


def test_held_out_grades(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "reading_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 1
    got = R.reading_levels(docs, labels.where(~held)).join(labels.where(held & F.col("reading_level").isNotNull()).withColumnRenamed("reading_level", "y"), "doc_id").where("reading_level is not null").collect()
    assert len(got) > 30
    assert np.mean([(r.reading_level >= 4) == (r.y >= 4) for r in got]) > 0.85
    assert np.mean([abs(r.reading_level - r.y) <= 1 for r in got]) > 0.9


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 1 + np.digitize(2 * x[:, 0] - x[:, 1] + rng.logistic(size=400) * 0.3, [-2, -0.7, 0.7, 2])
    m = R.fit_ordinal(x, y, np.ones(400))
    assert np.mean(m.level(x) == y) > 0.7 and (np.diff(m.cuts) > 0).all()


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "🙂"), (5, "公司卖玩具。"), (5, "公司卖玩具。"), (6, "久期缺口失效。" * 20_000)], "doc_id long, text string").selectExpr("*", "9 as reading_level", "'s' as source", "'zh' as lang")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    assert {r.reading_level for r in R.reading_levels(docs, none).collect()} == {None}
    bad = spark.createDataFrame([(5, "a", None), (None, "a", 3), (5, "a", 9)], "doc_id long, rater string, reading_level int")
    assert R.hard_documents(docs, bad).count() == 0
    base, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "reading_labels")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(base.select("doc_id", "text").unionAll(docs.select(-F.col("doc_id"), "text")), labels).where("doc_id < 0").collect()}
    assert got[-1] is None and got[-2] is None and got[-3] is None
    assert R.reading_levels(docs.limit(0), labels).count() == 0
