"""Queries of event windows, text pieces and sentence detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from finspark.operators import detectors, texts
from finspark.plans.shared import Catalog
from finspark.session import table
from finspark.streaming import windows

C = Catalog()
C.frame(
    "tumbling_counts",
    lambda spark, d: windows.tumbling(table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", "total"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
)
C.frame(
    "session_counts",
    lambda spark, d: windows.sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest")),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT user_id, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g), k AS (SELECT user_id, n, COUNT(*) AS c FROM s GROUP BY ALL)
    SELECT user_id, COUNT(*) AS sessions, MAX(c) AS longest FROM k GROUP BY user_id""",
)
C.frame("text_findings", lambda spark, d: detectors.detect(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))
C.frame("content_findings", lambda spark, d: detectors.detect(table(spark, d, "inputs_research442").select("document_id", "content").dropDuplicates(["document_id"]), "document_id", "content"))
C.frame("token_windows", lambda spark, d: texts.explode_windows(table(spark, d, "documents"), "doc_id", "text", 256))
C.frame("chunk_text", lambda spark, d: texts.explode_chunks(table(spark, d, "documents"), "doc_id", "text", 400))
C.frame("json_recovery", lambda spark, d: table(spark, d, "model_responses").select("response_key", texts.recovered_json(F.col("content")).alias("value")))
C.frame(
    "sequence_agreement",
    lambda spark, d: table(spark, d, "case_evidence").where("gold is not null").select("case_id", F.explode("gold.spans").alias("s")).select("case_id", texts.sequence_ratio(F.col("s.text"), F.col("s.original_text")).alias("ratio")),
)
QUERIES, SQL = C.queries, C.sql
