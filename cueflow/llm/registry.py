"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MODULES = ("topk", "jaccard", "bpe", "html_main", "chat", "toxicity", "perplexity", "packed", "quality", "mixing", "substring", "repair", "phrases")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> tuple[dict, dict]:
    """All queries of the package and the pipeline, with their SQL."""
    for m in _MODULES:
        importlib.import_module(f"cueflow.llm.{m}")
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
    return dict(QUERIES), dict(SQL)
