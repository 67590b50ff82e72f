"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from textloom.llm import clusters, copies, edits, leaks, overlaps, quotas, sentencing, subjects, tokens

QUERIES = {
    "p1_found": clusters.p1_found,
    "p1_clusters": clusters.p1_clusters,
    "p2_found": quotas.p2_found,
    "p2_report": quotas.p2_report,
    "p2_sample": quotas.p2_sample,
    "p3_found": subjects.p3_found,
    "p3_composition": subjects.p3_composition,
    "p4_found": copies.p4_found,
    "p4_ledger": copies.p4_ledger,
    "p5_found": overlaps.p5_found,
    "p5_report": overlaps.p5_report,
    "p5_coverage": overlaps.p5_coverage,
    "p6_found": edits.p6_found,
    "p6_groups": edits.p6_groups,
    "p7_ids": tokens.p7_ids,
    "p7_round_trip": tokens.p7_round_trip,
    "p8_found": leaks.p8_found,
    "p8_matches": leaks.p8_matches,
    "p8_clean": leaks.p8_clean,
    "p9_found": sentencing.p9_found,
}

ORACLES: dict[str, str] = quotas.ORACLES | tokens.ORACLES | clusters.ORACLES | overlaps.ORACLES | edits.ORACLES | leaks.ORACLES
