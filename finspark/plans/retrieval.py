"""Search, indexes and summaries of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.operators import lexical, vectors
from finspark.plans.shared import Catalog
from finspark.session import table

C = Catalog()
_TOK = """list_concat(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower(text), '[一-鿿]+'), lambda r: string_split(r, '')))),
   flatten(list_transform(regexp_extract_all(lower(text), '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))"""
_BM25 = f"""WITH q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM (SELECT item_id, substring(text, 1, 40) AS text FROM eval_items WHERE item_id % 20 = 0))),
  d AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT COUNT(*) AS n, AVG(len(t)) AS avgdl FROM d),
  x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT term, doc_id, dl, COUNT(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
  s AS (SELECT q.query_id, tf.doc_id, ROUND(SUM(LN(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS s FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
  SELECT query_id, doc_id, CAST(s AS DECIMAL(18,4)) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s WHERE s > 0) WHERE rank <= 5"""
C.frame(
    "bm25_topk",
    lambda spark, d: lexical.bm25_topk(
        table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("text"))
    ),
    _BM25,
)
# bm25_topk asks with the first 40 characters of an item, as its SQL states; this asks with the whole text
C.frame(
    "bm25_topk_whole",
    lambda spark, d: lexical.bm25_topk(
        table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    ),
    _BM25.replace("substring(text, 1, 40) AS text", "text"),
)
C.frame(
    "cosine_topk",
    lambda spark, d: vectors.cosine_topk(table(spark, d, "embeddings")),
    """SELECT query_id, vec_id, CAST(s AS DECIMAL(9,4)) AS score, CAST(rank AS INT) AS rank FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
      (SELECT q.vec_id AS query_id, v.vec_id, ROUND(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
)
C.frame(
    "vector_norms",
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4).cast("decimal(12,4)").alias("norm")),
    "SELECT vec_id, CAST(ROUND(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS DECIMAL(12,4)) AS norm FROM embeddings",
)
C.frame(
    "tokenize_bigrams",
    lambda spark, d: table(spark, d, "eval_items").select("item_id", F.size(lexical.tokens(F.col("text"))).alias("tokens"), F.size(F.array_distinct(lexical.tokens(F.col("text")))).alias("terms")),
    f"SELECT item_id, CAST(len(t) AS INT) AS tokens, CAST(len(list_distinct(t)) AS INT) AS terms FROM (SELECT item_id, {_TOK} AS t FROM eval_items)",
)
# tokenize_bigrams is over the 240 items; this is over the corpus, null for a null text
C.frame(
    "tokenize_bigrams_documents",
    lambda spark, d: table(spark, d, "documents").select("doc_id", lexical.tokens(F.col("text")).alias("t")).select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).alias("tokens"), F.when(F.col("t").isNotNull(), F.size(F.array_distinct("t"))).alias("terms")),
    f"SELECT doc_id, CAST(len(t) AS INT) AS tokens, CAST(len(list_distinct(t)) AS INT) AS terms FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_TOK} END AS t FROM documents)",
)
C.add("catalog_summary", "SELECT source, lang, scene, COUNT(*) AS documents, CAST(SUM(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY GROUPING SETS ((source), (lang), (scene))")
C.add("kb_index_export", "SELECT doc_id, run_id, page, block_id, block_type, text FROM {blocks} WHERE text IS NOT NULL AND TRIM(text) <> ''")
C.add("anchor_set_equality", "SELECT doc_id, COUNT(DISTINCT page) AS pages, COUNT(DISTINCT block_id) AS ids, COUNT(*) AS rows FROM {blocks} GROUP BY doc_id".replace(" AS rows", " AS n"))
C.add("corpus_import", "SELECT doc_id, COALESCE(NULLIF(TRIM(title), ''), NULLIF(TRIM(company), ''), 'untitled') AS name, CASE WHEN text IS NULL THEN 'skipped_null' WHEN NOT regexp_like(text, '[A-Za-z0-9一-鿿]') THEN 'skipped_blank' ELSE 'imported' END AS outcome FROM {documents}")
C.add("uri_binding", "SELECT i.document_id, p.prefix FROM (SELECT DISTINCT document_id FROM {inputs_research442}) i JOIN (SELECT DISTINCT substring(document_id, 1, position(':' IN document_id)) AS prefix FROM {inputs_research442} WHERE document_id IS NOT NULL) p ON substring(i.document_id, 1, position(':' IN i.document_id)) = p.prefix")
C.add("per_source_longest", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM {documents} WHERE n_chars IS NOT NULL) t WHERE rn <= 3")
C.add("late_documents", "SELECT doc_id, CAST(published_at AS DATE) AS published, CAST(crawled_at AS DATE) AS crawled FROM {documents} WHERE crawled_at > published_at + INTERVAL 30 DAY")
QUERIES, SQL = C.queries, C.sql
