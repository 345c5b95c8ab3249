"""Source adapters: each maps one raw source's columns onto the unified
example record (SRC-5, PRJ-1, PRJ-2, FLT-1, FLT-2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import classify_sql, has_ddl, strip

UNIFIED = ["sql_context", "sql_prompt", "gold_sql", "domain", "complexity", "source", "id"]


def _gold(c) -> F.Column:
    """strip, then drop trailing semicolons"""
    return F.regexp_replace(strip(c), ";+$", "")


def adapt_a(df: DataFrame) -> DataFrame:
    """Rows with (sql_context, sql_prompt, sql, domain, sql_complexity, id)."""
    return df.where(has_ddl("sql_context")).select(
        "sql_context", "sql_prompt", _gold(F.col("sql")).alias("gold_sql"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce(F.nullif(F.col("sql_complexity"), F.lit("")), classify_sql("sql")).alias("complexity"),
        F.lit("gretel").alias("source"), F.col("id").cast("string").alias("id"))


def adapt_b(df: DataFrame) -> DataFrame:
    """Rows with (context, question, answer): schema-only source, no ids."""
    g = _gold(F.coalesce(F.col("answer"), F.lit("")))
    return (df.withColumn("__g", g)
            .where(has_ddl("context") & (F.col("__g") != ""))
            .select(F.col("context").alias("sql_context"), F.col("question").alias("sql_prompt"),
                    F.col("__g").alias("gold_sql"), F.lit("").alias("domain"),
                    classify_sql("__g").alias("complexity"), F.lit("createcontext").alias("source"),
                    F.lit(None).cast("string").alias("id")))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gretel": adapt_a,
    "createcontext": adapt_b,
}


def read_sources(names: Sequence[str], raw: dict[str, DataFrame]) -> DataFrame:
    """Adapt and union the named sources; an unknown name is an error."""
    unknown = [n for n in names if n not in ADAPTERS]
    if unknown:
        raise ValueError(f"unknown source(s) {unknown}; available: {sorted(ADAPTERS)}")
    out = None
    for n in names:
        a = ADAPTERS[n](raw[n]).select(*UNIFIED)
        out = a if out is None else out.unionByName(a)
    return out
