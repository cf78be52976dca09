from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from finspark.llm import reading as R
from finspark.session import table

SF = "/root/testdata/sf0.01"


def test_names_are_as_many_as_features():
    flat = np.zeros(R.SLOTS)
    for text in ("The cash flow fell.", "公司现金流下降。", "🙂", "…！"):
        assert len(R.features(text, flat, flat, flat)[1]) == len(R.FEATURES)


def test_texts_without_tokens_get_a_level(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "reading_labels")
    model = R.fit(docs, labels)
    assert set(model.by_script) == {True, False}
    odd = ["🙂🙂", "…！？", "かな", "Привет", "账", " "]
    more = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs.unionAll(more), labels).where(F.col("doc_id") < 0).collect()}
    assert len(got) == len(odd) and got[-6] is None and all(1 <= got[-i] <= 5 for i in range(1, 6))


def test_a_script_with_few_grades_is_scored_too(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "reading_labels")
    zh = docs.where(F.col("text").rlike("[一-鿿]{5}")).select("doc_id")
    got = R.reading_levels(docs, labels.join(zh, "doc_id")).join(docs, "doc_id").where(F.col('text').rlike(r'[A-Za-z0-9一-鿿]'))
    assert got.where("reading_level is null").count() == 0 and got.where("text rlike '^[ -~]+$'").count() > 0
