"""The queries of this subpackage, each beside its SQL where SQL can say the same."""

from __future__ import annotations

import importlib

MODULES = ("url_filter", "pii", "simhash", "mixing", "huffman_store", "toxicity", "langid", "unigram", "embedding_dedup", "ann", "quality", "filter_audit", "lexical")


def _modules():
    return [importlib.import_module(f"gleanspark.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
