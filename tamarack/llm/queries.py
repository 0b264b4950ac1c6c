"""Queries of the training-text problems."""

from __future__ import annotations

from tamarack.llm import checks, leakage, mixing, packing, pairs, splitting, subjects, survivor, survivor_sql
from tamarack.session import load

QUERIES = {
    "p2_found": lambda spark, d: pairs.pairs_of(spark, d),
    "p2_report": lambda spark, d: pairs.pairs_of(spark, d).groupBy("defect").count().withColumnRenamed("count", "pairs"),
    "p4_requests": packing.requests_of,
    "p4_summary": packing.summary_of,
    "p5_found": lambda spark, d: splitting.pieces_of(spark, d).where("piece = 0 and pieces > 1").select("unit_id"),
    "p5_pieces": splitting.pieces_of,
    "p6_found": lambda spark, d: survivor.survivors_of(spark, d).select("row_id", "quantity"),
    "p7_found": leakage.leaks_of,
    "p7_report": lambda spark, d: leakage.leak_report(leakage.stretches_of(spark, d)),
    "p8_mix": mixing.mix_of,
    "p8_shares": mixing.report_of,
    "p9_found": lambda spark, d: subjects.document_subjects(subjects.shares_of(spark, d)),
    "p9_corpus": lambda spark, d: subjects.corpus_shares(subjects.shares_of(spark, d), load(spark, d, "documents")),
    "p6_records": lambda spark, d: survivor.built_records(survivor.consensus_values(survivor.values_of(spark, d))),
}
ORACLE = {
    "p6_found": survivor_sql.P6_FOUND,
    "p5_found": "SELECT unit_id FROM extraction_unit WHERE floor(length(text) / 4) > 1000",
}
QUERIES |= checks.QUERIES
ORACLE |= checks.ORACLE
