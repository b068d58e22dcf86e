"""Queries of the corpus operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from bidweave.llm import boilerplate, mixing, neardup, personal, scans, split, tokens

QUERIES = {
    "p2_found": neardup.found,
    "p3_found": split.found,
    "p3_pieces": split.oversized,
    "p4_found": boilerplate.found,
    "p4_clean": boilerplate.stripped,
    "p5_found": scans.found,
    "p5_repaired": scans.repaired,
    "p7_ids": tokens.ids,
    "p8_mix": mixing.mixed,
    "p8_shares": mixing.reached,
    "p9_found": personal.found,
    "p9_redacted": personal.redacted,
}

SQL = {
    "p2_found": neardup.FOUND_SQL,
    "p3_found": split.FOUND_SQL,
    "p4_found": boilerplate.FOUND_SQL,
    "p4_clean": boilerplate.CLEAN_SQL,
}
