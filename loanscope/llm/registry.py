"""The queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools
import importlib

from loanscope.llm.tables import ship

_MODULES = [
    "jaccard_join", "language_id", "suffix_dedup", "html_extract", "license_scan",
    "sentencepiece_bpe", "exact_dedup", "substring_dedup", "quality_rules", "packing",
    "quality_cnn", "vector_codes", "prefix_trie",
]


def load() -> list:
    """All modules with queries (a package that one of them needs and that is
    missing raises ImportError here)."""
    return [importlib.import_module(f"loanscope.llm.{m}") for m in _MODULES]


def _all(name: str) -> dict:
    out = {}
    for module in load():
        out.update(getattr(module, name))
    return out


def _shipping(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {k: _shipping(fn) for k, fn in _all("QUERIES").items()}


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL, where SQL can express it."""
    return _all("ORACLE")
