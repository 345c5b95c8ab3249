"""Registry of named queries: a Spark builder and, where one exists, the DuckDB
oracle SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    oracle: str | None
    bench: bool = False


_REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, bench: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query key {name!r}")
        _REGISTRY[name] = Entry(name, fn, oracle, bench)
        return fn
    return deco


def all_entries() -> dict[str, Entry]:
    import importlib
    for m in MODULES:
        importlib.import_module(f"quarry.plans.{m}")
    return dict(_REGISTRY)


# modules that register queries, in report order
MODULES = ["q_multilevel", "q_workload", "q_text", "q_compare", "q_report", "q_sample", "q_catalog", "q_select", "q_prompt", "q_generate", "q_exec", "q_io", "q_stream"]
