"""Products and degrees kept up to date while entries of a matrix arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_product(entries: DataFrame, x: DataFrame) -> DataFrame:
    """entries: a stream of i, j, v. A running A X as v, f, x, for output modes `update` and `complete`: new entries add
    to it, and equal places add up as in a matrix."""
    rows = x.select(F.col("v").alias("j"), "f", F.col("x").cast("double").alias("_x"))
    pairs = entries.join(rows, "j").select(F.col("i").alias("v"), "f", (F.col("v") * F.col("_x")).alias("x"))
    return pairs.groupBy("v", "f").agg(F.sum("x").alias("x"))


def streaming_degrees(entries: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Entries by vertex and window of event time; what is later than `late` is dropped and closed windows leave the state."""
    ends = entries.withWatermark(time, late).select(F.col(time).alias("t"), F.explode(F.array("i", "j")).alias("v"))
    return ends.groupBy(F.window("t", window).alias("w"), "v").agg(F.count("*").alias("d")).select("w.start", "v", "d")
