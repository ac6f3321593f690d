"""Peeling: a matrix as few levels, each near its diagonal or in its first rows and columns after reordering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import actual_width, keeps
from ..storage import materialise
from .linear_order import linear_order


@dataclass
class Levels:
    """edges: level, pi, pj, i, j, v; perm: level, pos, v (original vertex); meta: level, n, nnz, nonzero_rows, width, shape."""

    edges: DataFrame
    perm: DataFrame
    meta: DataFrame
    n: int


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def peel(spark: SparkSession, a: DataFrame, n: int, width: int, max_levels: int = 2, block: bool = False, prune: bool = True) -> Levels:
    """Split the entries of `a` (i, j, v on 0 to n - 1) over at most `max_levels` levels; each entry is in one level.

    A level keeps what lies near the diagonal in its own order; the rest goes to the next. The last level keeps
    everything, as does one that would keep nothing; its width is that of its farthest entry and its shape `general`.
    Components that fit into a width, of 16 vertices at most, are taken as they are, and in the last level pairs alone.
    Values and directions stay. Every level is written once.
    """
    vertices = spark.range(n).withColumnRenamed("id", "v")
    rest, edges, perms, meta = materialise(a.select("i", "j", "v"), "peel"), [], [], []
    for level in range(max_levels):
        last = level + 1 == max_levels
        perm = materialise(linear_order(rest, vertices, width, *(("levels", 2) if last else ("forest", max(1, min(width - 1, 16))))), "perm")
        placed = rest.join(perm.select(F.col("v").alias("i"), F.col("pos").alias("pi")), "i").join(perm.select(F.col("v").alias("j"), F.col("pos").alias("pj")), "j")
        kept = F.lit(True) if last else keeps(F.col("pi"), F.col("pj"), width, block, prune)
        placed = materialise(placed.withColumn("kept", kept), "peel")
        own = placed.where("kept").drop("kept")
        if not last and own.isEmpty():
            own, last = placed.drop("kept"), True
        edges.append(own.select(F.lit(level).alias("level"), "pi", "pj", "i", "j", "v"))
        perms.append(perm.select(F.lit(level).alias("level"), "pos", "v"))
        facts = own.agg(F.count("*").alias("nnz"), F.countDistinct("pi").alias("nonzero_rows"))
        wide = actual_width(own, width, "pi", "pj") if last else spark.range(1).select(F.lit(width).cast("long").alias("width"))
        shape = "general" if last else "block" if block else "band"
        meta.append(facts.join(wide).select(F.lit(level).alias("level"), F.lit(n).cast("long").alias("n"), "nnz", "nonzero_rows", "width", F.lit(shape).alias("shape")))
        rest = placed.where("NOT kept").select("i", "j", "v")
        if last or rest.isEmpty():
            break
    return Levels(_union(edges), _union(perms), _union(meta), n)


def invariants(levels: Levels, a: DataFrame) -> DataFrame:
    """One row per rule with `errors`, 0 where it holds: levels together are the input; no entry is in two levels; each
    permutation is a bijection; every level but a general one has its shape."""
    ours, theirs = levels.edges.select("i", "j", "v"), a.select("i", "j", "v")
    count = lambda df, name: df.agg(F.count("*").alias("errors")).select(F.lit(name).alias("rule"), "errors")
    twice = levels.edges.groupBy("i", "j").agg(F.count("*").alias("c")).where("c > 1")
    by_level = levels.perm.groupBy("level").agg(F.countDistinct("v").alias("x"), F.countDistinct("pos").alias("y"), F.count("*").alias("z"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    n = levels.n
    wrong = by_level.where(f"x <> {n} OR y <> {n} OR z <> {n} OR lo <> 0 OR hi <> {n - 1}")
    placed = levels.edges.join(F.broadcast(levels.meta.select("level", "width", "shape")), "level")
    fits = F.when(F.col("shape") == "block", F.expr("pi div width = pj div width")).otherwise(F.abs(F.col("pi") - F.col("pj")) <= F.col("width"))
    outside = placed.where(~fits & (F.col("pi") >= F.col("width")) & (F.col("pj") >= F.col("width")))
    return _union([
        count(ours.exceptAll(theirs).unionByName(theirs.exceptAll(ours)), "union_equals_input"),
        count(twice, "levels_disjoint"),
        count(wrong, "permutations_bijective"),
        count(outside, "structure"),
    ])


def placements(levels: Levels) -> DataFrame:
    """i, j, v, level, and of each entry whether its level's permutation has its row and column at the places it claims
    (`placed`) and whether these lie where the level's shape allows entries (`inside`)."""
    at = levels.perm.select("level", F.col("pos").alias("pi"), F.col("v").alias("_i")), levels.perm.select("level", F.col("pos").alias("pj"), F.col("v").alias("_j"))
    e = levels.edges.join(at[0], ["level", "pi"], "left").join(at[1], ["level", "pj"], "left")
    e = e.join(F.broadcast(levels.meta.select("level", "width", "shape")), "level", "left")
    near = F.when(F.col("shape") == "block", F.expr("pi div width = pj div width")).otherwise(F.abs(F.col("pi") - F.col("pj")) <= F.col("width"))
    inside = near | (F.col("pi") < F.col("width")) | (F.col("pj") < F.col("width"))
    placed = F.col("i").eqNullSafe(F.col("_i")) & F.col("j").eqNullSafe(F.col("_j"))
    return e.select("i", "j", "v", "level", placed.alias("placed"), F.coalesce(inside, F.lit(False)).alias("inside"))


def places_taken(levels: Levels) -> DataFrame:
    """v, as_vertex, as_place: whether each number stands once in every level's permutation as a vertex, and as a place."""
    count = levels.meta.count()
    once = lambda c: levels.perm.groupBy("level", F.col(c).alias("v")).agg(F.count("*").alias("c")).where("c = 1").groupBy("v").agg((F.count("*") == count).alias("ok"))
    v, p = once("v").withColumnRenamed("ok", "as_vertex"), once("pos").withColumnRenamed("ok", "as_place")
    return v.join(p, "v", "full").select("v", F.coalesce("as_vertex", F.lit(False)).alias("as_vertex"), F.coalesce("as_place", F.lit(False)).alias("as_place"))
