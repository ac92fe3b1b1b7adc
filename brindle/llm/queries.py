"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

import importlib

#: query name: module in this subpackage; each has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op3_line_dedup": "line_dedup",
    "op6_near_dedup": "near_dedup",
    "op7_html_text": "html_text",
    "op4_chat": "chat",
    "op9_quality": "quality",
    "op8_packing": "packing",
    "op1_secrets": "secrets",
    "op5_decontaminate": "decontaminate",
    "op2_pii": "pii",
    "op10_exact_dedup": "exact_dedup",
    "op11_simhash": "simhash",
    "op12_periodic_runs": "periodic",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: importlib.import_module(f"brindle.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"brindle.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
