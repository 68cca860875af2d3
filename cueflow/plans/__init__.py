"""Registered queries, one module per family of operators."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

import cueflow
from cueflow.plans.registry import QUERIES, SQL

_MODULES = ("text", "scans", "sequence", "joins", "memory", "audit", "findings", "canon", "journal", "streams")


def load():
    # Functions sent to tasks travel by value, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(cueflow)
    for m in _MODULES:
        importlib.import_module(f"cueflow.plans.{m}_queries")
    return QUERIES


def checks() -> dict[str, str]:
    load()
    return dict(SQL)
