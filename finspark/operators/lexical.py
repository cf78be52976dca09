"""Full-text ranking (BM25) over tokens of Chinese and other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased words, and single characters and pairs of neighbours for Chinese runs."""
    t = F.lower(text)
    words = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit("[一-鿿]+"), F.lit(0))
    singles = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))
    return F.concat(words, singles, F.filter(pairs, lambda p: F.length(p) == 2))


def bm25_topk(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of every query.

    documents: doc_id, text; queries: query_id, text. Only terms of the queries are kept of the corpus, and
    term counts are pre-aggregated per document before the join. Ties go to the smaller doc_id; null texts
    and queries without terms give no row.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = queries.where("query_id is not null and text is not null").select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    tf = docs.select("doc_id", "dl", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = weighted.select("term", "doc_id", part.alias("s")).join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 4).alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id"))
    top = scores.where("s > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", "doc_id", F.col("s").cast("decimal(18,4)").alias("score"), "rank")
