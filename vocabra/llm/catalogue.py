"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Query name and the module that has its ``query`` and, where SQL can express it, its ``ORACLE_SQL``.
MODULES = {
    "op1_pieces": "pieces",
    "op2_counts": "counts",
    "op3_lm": "lm",
    "op4_repeats": "repeats",
    "op5_near": "near",
    "op6_toxicity": "toxicity",
    "op7_leaks": "leaks",
    "op8_lines": "lines",
    "op9_urls": "urls",
    "op10_secrets": "secrets",
    "op11_repair": "repair",
    "op12_warc": "warc",
    "op13_trie": "trie",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    import corpus_pipeline

    return {name: _module(name).query for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
