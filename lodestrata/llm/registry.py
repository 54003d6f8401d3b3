"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, filter_audit, jaccard_join, language_id, line_dedup, mixing, nearest, packing, pii, secrets, simhash, substring_dedup, token_alignment

MODULES = (secrets, substring_dedup, nearest, packing, mixing, exact_dedup, pii, line_dedup, jaccard_join, language_id, token_alignment, filter_audit, simhash)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
