"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import p1_alignment, p2_language, p3_truncation, p4_survivor, p5_lookalike, p6_defects, p7_packing, p8_mixing, p9_spam

MODULES = (p1_alignment, p2_language, p3_truncation, p4_survivor, p5_lookalike, p6_defects, p7_packing, p8_mixing, p9_spam)


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
