"""Decompositions of several widths and modes side by side, each replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.peel import Levels

KEYS = ("asked", "mode")


class LevelStore:
    """Three Parquet tables: entries and permutations in folders by width asked for, mode and level, and one table of facts,
    a row for each level. Writing a decomposition replaces its own folders only (dynamic partition overwrite). The facts
    are written last and say how many levels count, so that levels of a longer one before it aren't read. One writer for a
    width and mode at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, levels: Levels, width: int, mode: str) -> None:
        for name, table, inner in (("edges", levels.edges, ["level"]), ("perm", levels.perm, ["level"]), ("facts", levels.meta, [])):
            keyed = table.withColumns({"asked": F.lit(width).cast("long"), "mode": F.lit(mode)})
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS, *inner).parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}")
        return table.withColumns({"asked": F.col("asked").cast("long"), "mode": F.col("mode").cast("string")})

    def known(self) -> DataFrame:
        """asked, mode, levels, n, nnz of each decomposition."""
        return self._read("facts").groupBy(*KEYS).agg((F.max("level") + 1).alias("levels"), F.max("n").alias("n"), F.sum("nnz").alias("nnz"))

    def get(self, width: int, mode: str, level: int | None = None) -> Levels:
        """All levels of one decomposition, or one level; only their folders are read. KeyError where the store has none."""
        own = (F.col("asked") == width) & (F.col("mode") == mode)
        facts = self._read("facts").where(own).drop(*KEYS)
        top = facts.agg(F.max("level"), F.max("n")).first()
        if top[0] is None or level is not None and not 0 <= level <= top[0]:
            raise KeyError((width, mode, level))
        some = F.col("level") <= top[0] if level is None else F.col("level") == level
        return Levels(self._read("edges").where(own & some).drop(*KEYS), self._read("perm").where(own & some).drop(*KEYS), facts.where(some), top[1])
