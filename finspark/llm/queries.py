"""Queries of this subpackage by name, and SQL that states the same result where SQL can."""

from __future__ import annotations

from finspark.llm import leakage, lookalikes, overlap, reading, scans, tokens, truncation
from finspark.session import table


def _two(f, a: str, b: str):
    return lambda spark, d: f(table(spark, d, a), table(spark, d, b))


QUERIES = {
    "p2_found": _two(lookalikes.spans_alike, "case_evidence", "inputs_research442"),
    "p2_consistent": _two(lookalikes.consistent_contents, "case_evidence", "inputs_research442"),
    "p3_found": _two(truncation.cut_records, "model_responses", "run_results"),
    "p3_share": _two(truncation.cut_share, "model_responses", "run_results"),
    "p4_found": _two(scans.defects, "ocr_lines", "blocks"),
    "p4_paragraphs": _two(scans.paragraphs, "ocr_lines", "blocks"),
    "p5_found": lambda spark, d: overlap.split_overlaps(table(spark, d, "inputs_research442")),
    "p5_report": lambda spark, d: overlap.overlap_report(table(spark, d, "inputs_research442")),
    "p6_ids": lambda spark, d: tokens.encode_documents(table(spark, d, "documents")),
    "p6_round_trip": lambda spark, d: tokens.round_trip(table(spark, d, "documents")),
    "p7_found": _two(leakage.leaked_pairs, "eval_items", "documents"),
    "p7_items": _two(leakage.leaked_items, "eval_items", "documents"),
    "p8_found": _two(reading.hard_documents, "documents", "reading_labels"),
    "p8_levels": _two(reading.reading_levels, "documents", "reading_labels"),
    "p8_profile": _two(reading.level_profile, "documents", "reading_labels"),
}
SQL: dict[str, str] = {}
