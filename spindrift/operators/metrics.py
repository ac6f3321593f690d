"""Errors of results, statistics of run times, and a log of metrics as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METRICS = "run_id string, rank long, iteration long, name string, value double"


def error_norms(y: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: relative L2 norm of the difference, the largest difference, and whether all are within tolerance.
    An absent value is 0."""
    r = reference.select("v", "f", F.col("x").alias("_r"))
    both = y.select("v", "f", "x").join(r, ["v", "f"], "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("_r", F.lit(0.0)).alias("r"))
    d = F.col("x") - F.col("r")
    size = F.sum(F.col("r") * F.col("r"))
    return both.agg(
        (F.sqrt(F.sum(d * d)) / F.when(size > 0, F.sqrt(size)).otherwise(1.0)).alias("relative_l2"),
        F.max(F.abs(d)).alias("max_abs"),
        F.coalesce(F.bool_and(F.abs(d) <= tolerance * (1 + F.abs("r"))), F.lit(True)).alias("close"),
    )


def runtime_stats(metrics: DataFrame) -> DataFrame:
    """name, n, median and population standard deviation."""
    return metrics.groupBy("name").agg(F.count("*").alias("n"), F.expr("percentile(value, 0.5)").alias("median"), F.stddev_pop("value").alias("deviation"))


class MetricLog:
    """Values of one run; what set_iteration names is merged into later values. flush appends them to a Parquet table."""

    def __init__(self, spark: SparkSession, run_id: str, rank: int = 0) -> None:
        self.spark, self.run_id, self.rank, self.iteration, self.rows = spark, run_id, rank, None, []
        self.watched: list[tuple[int | None, Observation]] = []

    def set_iteration(self, iteration: int) -> None:
        self.iteration = iteration

    def log(self, **values: float) -> None:
        self.rows += [(self.run_id, self.rank, self.iteration, k, float(v)) for k, v in values.items()]

    def watch(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df, whose aggregates are taken on the way when it is written or read for the first time; `gather` logs them under
        the iteration of now. They cost no job of their own. Put it right before the write: tasks of earlier stages may run
        twice when executors are lost."""
        seen = Observation()
        self.watched.append((self.iteration, seen))
        return df.observe(seen, *[found.alias(name) for name, found in aggregates.items()])

    def gather(self) -> None:
        """Log what was watched; each such DataFrame must have been written or read by now. A null (nothing to add up) isn't logged."""
        for iteration, seen in self.watched:
            self.rows += [(self.run_id, self.rank, iteration, k, float(v)) for k, v in seen.get.items() if v is not None]
        self.watched = []

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, METRICS)

    def flush(self, path: str) -> None:
        self.table().write.mode("append").parquet(path)
        self.rows = []


def not_logged(runs: DataFrame, logged: DataFrame) -> DataFrame:
    """Runs whose id the log doesn't have yet."""
    return runs.join(logged, "run_id", "left_anti")
