"""Scan of the test tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {TABLES}")
    return spark.read.parquet(table_path(sf_dir, name))


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the base tables as temp views under their own names."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
