"""Registry of the queries over the text, page and vector tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_OPERATORS = ["ngram_join", "language", "topk", "warc", "url_filter", "wrappers", "quality", "substring_dedup", "decontaminate", "bpe",
              "simhash", "collocations", "hard_negatives"]


def register(name: str, sql: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan
    return keep


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for operator in _OPERATORS:
        import_module(f"standlab.llm.{operator}")
    return QUERIES, SQL
