"""Deterministic matrices of any size, made by hashes of their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier, increment and modulus of the generator of places and values.
STEP, SHIFT, MODULUS = 1103515245, 12345, 2147483647


def scramble(x: Column, seed: int) -> Column:
    """0 to MODULUS - 1, by two rounds of a congruential step; the same in any SQL engine."""
    once = (F.pmod(x, F.lit(MODULUS)) * STEP + SHIFT + seed) % MODULUS
    return (once * 48271 + seed) % MODULUS


def sparse(spark: SparkSession, rows: int, columns: int, nnz: int, seed: int = 42) -> DataFrame:
    """ceil(nnz / rows) entries a row at scattered columns, values in [0, 1); places that meet are added."""
    each = -(-nnz // rows)
    at = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    key = F.col("i") * each + F.col("k")
    at = at.select("i", (scramble(key, seed) % columns).alias("j"), ((scramble(key, seed + 1) % 1000) / 1000).alias("v"))
    return at.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dense(spark: SparkSession, rows: int, features: int, seed: int = 42) -> DataFrame:
    """v, f, x in [-1, 1)."""
    at = spark.range(rows).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("f"))
    return at.select("v", "f", (2 * (scramble(F.col("v") * features + F.col("f"), seed) % 1000) / 1000 - 1).alias("x"))


def attachment(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """A graph with hubs: vertex v links to m earlier ones, at v times the square of a pseudo-random share, so small
    ids gather links. i > j; duplicates are merged."""
    at = spark.range(1, n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"))
    share = scramble(F.col("i") * m + F.col("k"), seed) / MODULUS
    at = at.select("i", F.floor(F.col("i") * share * share).cast("long").alias("j"))
    return at.distinct().withColumn("v", F.lit(1.0))


def uniform(spark: SparkSession, n: int, mean_degree: float, seed: int = 42) -> DataFrame:
    """An undirected graph in which every pair is as likely: about n * mean_degree / 2 edges, i < j."""
    edges = int(n * mean_degree / 2)
    at = spark.range(edges).select((scramble(F.col("id"), seed) % n).alias("a"), (scramble(F.col("id") * (F.col("id") % 9973 + 17), seed + 7) % n).alias("b"))
    return at.where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct().withColumn("v", F.lit(1.0))


def structured(spark: SparkSession, n: int, width: int) -> DataFrame:
    """Dense first rows and columns and a diagonal; row 1 left of the middle and column 3 below it are empty."""
    side = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(width, n) - 1).cast("long"))).alias("j"))
    both = side.unionByName(side.select(F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"))).distinct()
    both = both.where(~((F.col("i") == 1) & (F.col("j") < n // 2)) & ~((F.col("j") == 3) & (F.col("i") > n // 2)))
    return both.withColumn("v", (1 + scramble(F.col("i") * n + F.col("j"), 42) % 9).cast("double"))
