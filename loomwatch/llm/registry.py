"""The queries and SQL of this subpackage, gathered from its modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "quality", "decontaminate", "jaccard", "line_dedup", "warc", "urlfilter", "ngram_lm", "chat", "pieces", "bpe", "runs", "resample")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"loomwatch.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"loomwatch.llm.{m}").SQL.items()}
