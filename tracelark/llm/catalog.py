"""The registry of the training-data queries."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Query name, module, and whether the module's ORACLE_SQL gives the same rows in SQL.
_QUERIES = (
    ("op1_ngram_join", "ngram_join", False),
    ("op2_quality", "quality", False),
    ("op3_decontaminate", "decontaminate", False),
    ("op4_language_id", "language", False),
    ("op5_line_dedup", "line_dedup", False),
    ("op6_chat_format", "chat_format", True),
    ("op7_packing", "packing", False),
    ("op8_license_scan", "license_scan", False),
    ("op9_url_filter", "url_filter", True),
    ("op10_topk_search", "topk_search", True),
    ("op11_ranked_search", "ranked_search", True),
    ("op12_conversation_repair", "conversation_repair", True),
    ("op13_fingerprints", "fingerprints", False),
)


def _module(name: str):
    return importlib.import_module(f"tracelark.llm.{name}")


def queries() -> dict:
    return {name: getattr(_module(module), name) for name, module, _ in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: _module(module).ORACLE_SQL for name, module, sql in _QUERIES if sql}
