"""Products of a sparse matrix A (i, j, v) with a tall, narrow dense matrix X (v, f, x), by several plans.

All plans give rows (v, f, x) of A X; rows of A without entries are absent. Values are added as doubles.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matrix import with_tiles
from ..storage import materialise, shared_dir
from .metrics import MetricLog
from .peel import Levels


def _summed(products: DataFrame, *keys: str) -> DataFrame:
    return products.groupBy(*keys).agg(F.sum("x").alias("x"))


def _rows(x: DataFrame, name: str) -> DataFrame:
    return x.select(F.col("v").alias(name), "f", F.col("x").cast("double").alias("_x"))


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """Direct: pair A's columns with X's rows and add by row and feature; partial sums come before the shuffle."""
    pairs = a.join(_rows(x, "j"), "j").select(F.col("i").alias("v"), "f", (F.col("v") * F.col("_x")).alias("x"))
    return _summed(pairs, "v", "f")


def multiply_wide(a: DataFrame, x: DataFrame, features: list[str], group: int = 32) -> DataFrame:
    """X wide (v and one column a feature): one shuffled row per row of A instead of one per feature; features go in
    groups whose generated code is small enough to be compiled."""
    out = None
    for k in range(0, len(features), group):
        part = features[k : k + group]
        paired = a.withColumnRenamed("v", "_a").join(x.select(F.col("v").alias("j"), *part), "j")
        summed = paired.groupBy(F.col("i").alias("v")).agg(*[F.sum(F.col("_a") * F.col(c)).alias(c) for c in part])
        out = summed if out is None else out.join(summed, "v")
    return out


def multiply_arrays(a: DataFrame, x: DataFrame, features: int) -> DataFrame:
    """Many features: X has a row per vertex (v, x: an array of that length); products go through wide rows and come out as
    rows (v, f, x), so that neither the join nor the shuffle has a row per feature."""
    names = [f"f{k}" for k in range(features)]
    wide = multiply_wide(a, x.select("v", *[F.col("x")[k].cast("double").alias(c) for k, c in enumerate(names)]), names)
    return wide.select("v", F.posexplode(F.array(*names)).alias("f", "x"))


def multiply_levels(levels: Levels, x: DataFrame) -> DataFrame:
    """Each level in its own order: rows of X go to the level's positions, products are added there, and the sums go
    back to the vertices and are added over levels. Rows go straight from vertices to any level, not level by level."""
    moved = levels.perm.join(x, "v").select("level", F.col("pos").alias("pj"), "f", F.col("x").cast("double").alias("_x"))
    pairs = levels.edges.join(moved, ["level", "pj"]).select("level", F.col("pi").alias("pos"), "f", (F.col("v") * F.col("_x")).alias("x"))
    back = _summed(pairs, "level", "pos", "f").join(levels.perm, ["level", "pos"])
    return _summed(back, "v", "f")


def multiply_tiles(a: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """By tiles of size x size: products are added within a tile first, then over the tiles of a row of tiles."""
    tiles = with_tiles(a, size)
    blocks = x.select(F.expr(f"v div {size}").alias("bj"), F.pmod("v", F.lit(size)).alias("rj"), "f", F.col("x").cast("double").alias("_x"))
    pairs = tiles.join(blocks, ["bj", "rj"]).select("bi", "bj", "ri", "f", (F.col("v") * F.col("_x")).alias("x"))
    sums = _summed(_summed(pairs, "bi", "bj", "ri", "f"), "bi", "ri", "f")
    return sums.select((F.col("bi") * size + F.col("ri")).alias("v"), "f", "x")


#: Rows and columns of a compressed tile: it has that many entries at most, and uses as many rows of X.
TILE_ROWS, TILE_COLUMNS = 16384, 2048
#: Entries up to which neighbouring tiles of the same rows are multiplied together, and numbers that a step of that holds.
TASK_ENTRIES, TASK_NUMBERS = 500_000, 1 << 22


def compressed_tiles(a: DataFrame, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """A row for each tile with entries: bi, bj, `row` and `used` (its rows and columns with entries, in order), `indptr`
    (where each of these rows begins), `indices` (places in `used`) and `data`."""

    def compress(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        i, j, v = (table[c].to_numpy() for c in "ijv")
        order = np.lexsort((j, i))
        row, start = np.unique(i[order], return_index=True)
        used, indices = np.unique(j[order], return_inverse=True)
        one = {"bi": [bi], "bj": [bj], "row": [row], "used": [used], "indptr": [np.append(start, len(order)).astype(np.int32)], "indices": [indices.astype(np.int32)], "data": [v[order].astype(float)]}
        return pa.table(one, pa.schema([("bi", pa.int64()), ("bj", pa.int64()), *((c, pa.list_(k)) for c, k in (("row", pa.int64()), ("used", pa.int64()), ("indptr", pa.int32()), ("indices", pa.int32()), ("data", pa.float64())))]))

    placed = a.select(F.expr(f"i div {rows}").alias("bi"), F.expr(f"j div {columns}").alias("bj"), "i", "j", "v")
    made = "bi long, bj long, row array<long>, used array<long>, indptr array<int>, indices array<int>, data array<double>"
    return placed.groupBy("bi", "bj").applyInArrow(compress, made)


def multiply_compressed(tiles: DataFrame, x: DataFrame, features: int, entries: int = TASK_ENTRIES) -> DataFrame:
    """tiles: as compressed_tiles makes them; x: v and x, an array of so many numbers. Rows (v, f, x) of A X.

    Neighbouring tiles of the same rows go together up to so many entries and meet the rows of X that they use, no others
    and each once, so X is reduced before it is shuffled: an entry takes one row of X at most, however large A is. Products
    are made in numpy, a sum over each row's run of entries. Only rows of several such groups are added by Spark.
    """

    def product(tile: pa.Table, block: pa.Table) -> pa.Table:
        rows, sums, alone = np.zeros(0, np.int64), np.zeros((0, features)), True
        if tile.num_rows and block.num_rows:
            alone, v = tile["alone"][0].as_py(), block["v"].to_numpy()
            order = np.argsort(v)
            v, dense = v[order], block["x"].combine_chunks().flatten().to_numpy().reshape(-1, features)[order]
            rows = np.unique(tile["row"].combine_chunks().flatten().to_numpy())
            sums, some = np.zeros((len(rows), features)), np.zeros(len(rows), bool)
            for k in range(tile.num_rows):
                row, used, indptr, indices, data = (tile[c][k].values.to_numpy() for c in ("row", "used", "indptr", "indices", "data"))
                at, to = np.minimum(np.searchsorted(v, used), len(v) - 1), np.searchsorted(rows, row)
                known = v[at] == used
                own = np.where(known[:, None], dense[at], 0.0)  # a row that X lacks is 0
                some[to] |= np.logical_or.reduceat(known[indices], indptr[:-1])
                step = max(1, TASK_NUMBERS // len(data))
                for f in range(0, features, step):
                    sums[to, f : f + step] += np.add.reduceat(own[indices, f : f + step] * data[:, None], indptr[:-1])
            rows, sums = rows[some], sums[some]
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * features, pa.int32()), pa.array(sums.reshape(-1)))
        return pa.table({"v": rows, "x": arrays, "alone": [alone] * len(rows)}, pa.schema([("v", pa.int64()), ("x", pa.list_(pa.float64())), ("alone", pa.bool_())]))

    tiles = materialise(tiles, "tiles")
    before = Window.partitionBy("bi").orderBy("bj").rowsBetween(Window.unboundedPreceding, -1)
    placed = tiles.select("bi", "bj", F.floor(F.coalesce(F.sum(F.size("data")).over(before), F.lit(0)) / entries).alias("part"))
    placed = placed.withColumn("alone", F.max("part").over(Window.partitionBy("bi")) == 0)
    tiles = tiles.join(placed, ["bi", "bj"])
    need = tiles.select(F.col("bi").alias("ti"), F.col("part").alias("tp"), F.explode("used").alias("v"))
    blocks = need.join(x.select("v", "x"), "v")
    parts = tiles.groupBy("bi", "part").cogroup(blocks.groupBy("ti", "tp")).applyInArrow(product, "v long, x array<double>, alone boolean")
    parts = materialise(parts, "products")
    rows = lambda some: parts.where(some).select("v", F.posexplode("x").alias("f", "x"))
    return rows("alone").unionByName(_summed(rows("NOT alone"), "v", "f"))


class Stationary:
    """A kept in place: a table bucketed and sorted by column. X is kept in a table of as many buckets by vertex, so that a
    product joins bucket with bucket, and only its partial sums are shuffled: to the buckets of the next X.

    x is wide: v and one column a feature. The tables are the session's, in the shared folder; `close` drops them.
    """

    def __init__(self, a: DataFrame, buckets: int | None = None) -> None:
        self.spark, self.name, self.nth = a.sparkSession, f"stationary_{uuid.uuid4().hex}", 0
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries = a.select("i", F.col("j").alias("v"), F.col("v").cast("double").alias("_a"))
        self.a = self._write(entries.repartition(self.buckets, "v"), "a")

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{self.name}_{name}"

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").bucketBy(self.buckets, "v").sortBy("v").option("path", self._path(name)).saveAsTable(f"{self.name}_{name}")
        return self.spark.table(f"{self.name}_{name}")

    def keep(self, x: DataFrame, dealt: bool = False) -> DataFrame:
        """x in buckets; it takes the place of the one before the last. dealt: it is a product, and so lies by vertex."""
        self.nth += 1
        return self._write(x if dealt else x.repartition(self.buckets, "v"), f"x{self.nth % 2}")

    def product(self, x: DataFrame) -> DataFrame:
        """x as keep gives it. v and the features of A X; rows of A without entries are absent."""
        features = [c for c in x.columns if c != "v"]
        pairs = self.a.join(x, "v")
        return pairs.groupBy(F.col("i").alias("v")).agg(*[F.sum(F.col("_a") * F.col(c)).alias(c) for c in features])

    def close(self) -> None:
        for name in ("a", "x0", "x1"):
            if self.spark.catalog.tableExists(f"{self.name}_{name}"):
                self.spark.sql(f"DROP TABLE {self.name}_{name}")
                self.spark.range(0).write.mode("overwrite").parquet(self._path(name))


def iterate_stationary(a: DataFrame, x: DataFrame, times: int, buckets: int | None = None) -> DataFrame:
    """X := A X, `times` times, x wide (v and one column a feature); A is shuffled once, however many steps there are."""
    kept = Stationary(a, buckets)
    for k in range(times):
        x = kept.product(kept.keep(x, dealt=k > 0))
    x = materialise(x, "stationary")
    kept.close()
    return x


def multiply_owned(a: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """One owner for each diagonal tile, holding also the first row's and the first column's tiles at its place: owner
    max(bi, bj). Entries are dealt by owner, and the first row of tiles is reduced over the owners."""
    owned = with_tiles(a, size).withColumn("owner", F.greatest("bi", "bj"))
    pairs = owned.join(_rows(x, "j"), "j").select("owner", F.col("i").alias("v"), "f", (F.col("v") * F.col("_x")).alias("x"))
    return _summed(_summed(pairs, "owner", "v", "f"), "v", "f")


def multiply_replicated(a: DataFrame, x: DataFrame, n: int, processes: int, copies: int) -> DataFrame:
    """A stays on a grid of processes / copies by copies; in each round a column of the grid gets one block of X, and
    partial results are added over the copies."""
    if processes % copies or processes % (copies * copies):
        raise ValueError("copies and their square must divide processes")
    g, rounds = processes // copies, processes // (copies * copies)
    size = max(1, math.ceil(n / g))
    grid = a.withColumns({"px": F.expr(f"i div {size}"), "kb": F.expr(f"j div {size}")}).withColumn("py", F.expr(f"kb div {rounds}"))
    blocks = x.select(F.expr(f"v div {size}").alias("kb"), F.col("v").alias("j"), "f", F.col("x").cast("double").alias("_x"))
    pairs = grid.join(blocks, ["kb", "j"]).select("px", "py", F.col("i").alias("v"), "f", (F.col("v") * F.col("_x")).alias("x"))
    return _summed(_summed(pairs, "px", "py", "v", "f"), "v", "f")


def multiply_slices(a: DataFrame, x: DataFrame, ranges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """By row slices (ranges: part, lo, hi): each slice adds its local columns' products and those of rows fetched from
    other slices; with `start` (v, f, x) the result is added to it."""
    r = F.broadcast(ranges)  # a row for each slice
    own = a.join(r, (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).withColumn("local", (F.col("j") >= F.col("lo")) & (F.col("j") < F.col("hi")))
    pairs = own.join(_rows(x, "j"), "j").select("part", "local", F.col("i").alias("v"), "f", (F.col("v") * F.col("_x")).alias("x"))
    parts = _summed(pairs, "part", "local", "v", "f").select("v", "f", "x")
    return _summed(parts if start is None else parts.unionByName(start.select("v", "f", F.col("x").cast("double").alias("x"))), "v", "f")


def iterate(step, x: DataFrame, times: int, every: int = 2, log: MetricLog | None = None) -> DataFrame:
    """X := step(X), `times` times; written every few steps, so plans stay short. With a log every step is written, and its
    number of rows, total and largest size are taken by that write and logged under the step's number."""
    for k in range(1, times + 1):
        x = step(x)
        if log is not None:
            log.set_iteration(k)
            x = materialise(log.watch(x, rows=F.count("*"), total=F.sum("x"), largest=F.max(F.abs("x"))), "iterate")
            log.gather()
        elif k % every == 0 and k < times:
            x = materialise(x, "iterate")
    return x
