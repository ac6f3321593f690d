"""Who owns what, and what must move: tables of row slices and of permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that are sent to all tasks: 24 bytes each.
MOST_SENT = 1 << 18


def slice_ranges(sizes: DataFrame) -> DataFrame:
    """sizes: part, n. part, lo, hi: the rows of each slice, by running sums. One row for each slice."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("part", (F.sum("n").over(upto) - F.col("n")).alias("lo"), F.sum("n").over(upto).alias("hi"))


def even_ranges(spark: SparkSession, n: int, parts: int) -> DataFrame:
    size = -(-n // parts)
    return spark.range(parts).select(F.col("id").alias("part"), F.least(F.col("id") * size, F.lit(n)).alias("lo"), F.least((F.col("id") + 1) * size, F.lit(n)).alias("hi"))


def with_owner(df: DataFrame, ranges: DataFrame, column: str, owner: str) -> DataFrame:
    """Add the slice whose range holds the column; rows that no range holds are left out. Ranges don't overlap.

    Up to MOST_SENT ranges are sent as a sorted array, in which each value is searched; more are joined by the cells of a
    grid, of which there are as many as ranges, so that a range stands in two or three of them on average."""
    known = ranges.where("lo < hi").select("part", "lo", "hi")
    size = known.agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if size["n"] <= MOST_SENT:
        held = known.orderBy("lo").toArrow()
        shared = df.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("part", "lo", "hi")))

        @F.pandas_udf("long")
        def search(values: pd.Series) -> pd.Series:
            part, lo, hi = shared.value
            found = pd.Series(pd.NA, values.index, "Int64")
            x = values.dropna()
            if len(lo) and len(x):
                at = np.searchsorted(lo, x.to_numpy(np.int64), "right") - 1
                inside = (at >= 0) & (x.to_numpy(np.int64) < hi[at])
                found[x.index[inside]] = part[at[inside]]
            return found

        kind = ranges.schema["part"].dataType
        return df.withColumn(owner, search(F.col(column).cast("long")).cast(kind)).where(F.col(owner).isNotNull())
    cell = max(1, -(-(size["hi"] - size["lo"]) // size["n"]))
    place = lambda x: F.floor((x - size["lo"]) / cell)
    index = known.select(F.col("part").alias(owner), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(place(F.col("lo")), place(F.col("hi") - 1))).alias("_cell"))
    both = df.withColumn("_cell", place(F.col(column))).join(index, "_cell")
    return both.where((F.col(column) >= F.col("_lo")) & (F.col(column) < F.col("_hi"))).drop("_cell", "_lo", "_hi")


def localised(df: DataFrame, ranges: DataFrame, column: str) -> DataFrame:
    """Add the slice that owns the column, `owner`, and the column's place in that slice, `at`."""
    owned = with_owner(df, ranges, column, "owner")
    starts = F.broadcast(ranges.select(F.col("part").alias("owner"), F.col("lo").alias("_lo")))
    return owned.join(starts, "owner").withColumn("at", F.col(column) - F.col("_lo")).select(*df.columns, "owner", "at")


def receive_table(a: DataFrame, ranges: DataFrame) -> DataFrame:
    """part, owner, j: columns that a slice uses and another one owns."""
    owned = with_owner(with_owner(a.select("i", "j"), ranges, "i", "part"), ranges, "j", "owner")
    return owned.where("part <> owner").select("part", "owner", "j").distinct()


def send_table(received: DataFrame) -> DataFrame:
    """owner, part, j, nth: the same rows as their owner sends them, numbered for each receiver."""
    nth = (F.row_number().over(Window.partitionBy("owner", "part").orderBy("j")) - 1).cast("long")
    return received.select("owner", "part", "j", nth.alias("nth"))


def tables_agree(received: DataFrame, sent: DataFrame) -> DataFrame:
    """One row: `errors`, rows that only one of the tables has."""
    r, s = received.select("part", "owner", "j"), sent.select("part", "owner", "j")
    return r.exceptAll(s).unionByName(s.exceptAll(r)).agg(F.count("*").alias("errors"))


def peer_counts(received: DataFrame, ranges: DataFrame) -> DataFrame:
    """part, owner, rows: for every pair of slices, 0 too. One row for each pair of slices."""
    parts = ranges.select("part")
    pairs = parts.join(F.broadcast(parts.withColumnRenamed("part", "owner")))
    found = received.groupBy("part", "owner").agg(F.count("*").alias("rows"))
    return pairs.join(found, ["part", "owner"], "left").select("part", "owner", F.coalesce("rows", F.lit(0)).alias("rows"))


def displacements(counts: DataFrame, by: str = "part", order: str = "owner") -> DataFrame:
    """Add `displ`: the sum of the counts before, within `by`."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("displ", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def moved_rows(perm: DataFrame, level_from: int, level_to: int) -> DataFrame:
    """pos, to: the position in the one level and in the other of the same vertex."""
    a = perm.where(F.col("level") == level_from).select("v", "pos")
    b = perm.where(F.col("level") == level_to).select("v", F.col("pos").alias("to"))
    return a.join(b, "v").select("pos", "to")


def all_to_all(moves: DataFrame, rows_per_rank: int, ranks: int, features: int, put_offset: int = 0) -> DataFrame:
    """moves: pos, to. Each row's sender, receiver, places in the send and the receive order, and per receiver the count
    of values and their displacement. Rows for a receiver beyond the last rank are dummies and left out; `put_offset`
    moves the receivers' numbers. Ranks are few: windows run within a sender."""
    m = moves.select("pos", "to", F.expr(f"pos div {rows_per_rank}").alias("rank"), F.expr(f"`to` div {rows_per_rank} + {put_offset}").alias("peer"))
    m = m.where(F.col("peer") < ranks)
    send = Window.partitionBy("rank").orderBy("peer", "pos")
    receive = Window.partitionBy("rank").orderBy("peer", "to")
    m = m.withColumn("send_nth", (F.row_number().over(send) - 1).cast("long")).withColumn("receive_nth", (F.row_number().over(receive) - 1).cast("long"))
    count = m.groupBy("rank", "peer").agg((F.count("*") * features).alias("count"))
    before = Window.partitionBy("rank").orderBy("peer").rowsBetween(Window.unboundedPreceding, -1)
    return m.join(count.withColumn("displ", F.coalesce(F.sum("count").over(before), F.lit(0))), ["rank", "peer"])


def volume(a: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: `local` and `fetched` (distinct rows of X that slices use of their own and of others), what a multiplication moves."""
    used = with_owner(with_owner(a.select("i", "j"), ranges, "i", "part"), ranges, "j", "owner").select("part", "owner", "j").distinct()
    return used.agg(F.count_if(F.col("part") == F.col("owner")).alias("local"), F.count_if(F.col("part") != F.col("owner")).alias("fetched"))
