"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query -> module; each module has a function of the query's name and may have its SQL in ORACLE_SQL.
NAMES = {
    "op1_language_id": "language",
    "op2_substring_dedup": "substring_dedup",
    "op3_token_counts": "token_counts",
    "op4_license_scan": "licenses",
    "op5_packing": "packing",
    "op6_jaccard_join": "jaccard_join",
    "op7_decontamination": "decontamination",
    "op8_quality_rules": "quality_rules",
    "op9_personal_data": "personal_data",
    "op10_quality": "quality",
}


def _module(name: str):
    return import_module(f"tallyforge.llm.{NAMES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in NAMES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
