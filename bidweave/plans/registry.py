"""Registered queries by name, and the SQL each is checked against."""

from __future__ import annotations

from bidweave.operators import amendments, assembly, chunking, classify, clean, history, indexing, instants, retrieve, routing, tables, trace, validation

_MODULES = (clean, classify, assembly, chunking, tables, retrieve, indexing, validation, routing, amendments, trace)

QUERIES = {"p1_found": instants.found, "p6_found": history.found}
SQL = {"p6_found": history.FOUND_SQL}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
