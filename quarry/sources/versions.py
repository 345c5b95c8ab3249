"""Folders that hold versions of a table (SNK-1, SNK-3, SNK-4).

A version is written to a folder of its own and counts once its manifest is
there: one small row that names the folder and its number of rows.  Readers
follow the latest manifest, so a table can be rewritten while it is read, and a
writer that dies before its manifest leaves the old version as it was.  Two
writers of the same version number cannot both commit.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, folder string, n long"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        """version, folder, n of what is committed; empty if nothing is."""
        try:
            return self.spark.read.schema(MANIFEST).json(os.path.join(self.path, "manifests", "*"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def latest(self):
        return self.versions().orderBy(F.desc("version")).first()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the latest one if none is named."""
        row = self.latest() if version is None else self.versions().where(F.col("version") == version).first()
        if row is None:
            raise FileNotFoundError(f"no such version in {self.path}")
        return self.spark.read.parquet(os.path.join(self.path, row["folder"]))

    def stage(self, df: DataFrame) -> tuple[str, int]:
        """Write rows that no reader sees yet: their folder and number."""
        folder, seen = f"data-{uuid.uuid4().hex}", Observation("rows")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(os.path.join(self.path, folder))
        return folder, int(seen.get.get("n", 0))

    def commit(self, folder: str, n: int, version: int) -> int:
        """Make staged rows the given version; fails if it is already there."""
        row = self.spark.createDataFrame([(version, folder, n)], MANIFEST)
        row.coalesce(1).write.mode("errorifexists").json(os.path.join(self.path, "manifests", f"{version:012d}"))
        return n

    def write(self, df: DataFrame) -> int:
        """A new version with the rows of ``df``; their number."""
        last = self.latest()
        return self.commit(*self.stage(df), (last["version"] if last else 0) + 1)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
        """A new version from the latest one; rows before and after (SNK-3)."""
        last = self.latest()
        if last is None:
            raise FileNotFoundError(f"no version in {self.path}")
        staged = self.stage(change(self.read(last["version"])))
        return last["n"], self.commit(*staged, last["version"] + 1)

    def keep(self, df: DataFrame) -> int:
        """Write ``df`` unless a version is there already (SNK-4): its number of rows."""
        last = self.latest()
        return last["n"] if last else self.write(df)
