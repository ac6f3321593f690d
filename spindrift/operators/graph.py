"""Graph operators as rounds of joins; each round's table is written, so lineage stays short."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import Rounds, materialise, number_rows, shared_dir

#: Edges that disjoint sets are made of at once in a task; a graph that has no more left is finished by one task.
CHUNK = 500_000


def _disjoint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges, ascending, and the smallest one that each reaches: roots are hooked to smaller ones and paths
    halved, all at once, until both ends of every edge agree."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at.reshape(2, -1)
    top = np.arange(len(ids))
    while len(a):
        x, y = top[a], top[b]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top, up := top[top]):
            top = up
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    return ids, ids[top]


def _lightest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges in ascending order those of the lightest forest: every set of vertices takes its first edge to another."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at.reshape(2, -1)
    taken, left, top = np.zeros(len(a), bool), np.arange(len(a)), np.arange(len(ids))
    while True:
        left = left[top[a[left]] != top[b[left]]]
        if not len(left):
            return np.flatnonzero(taken)
        x, y = top[a[left]], top[b[left]]
        first = np.full(len(ids), len(taken))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        won = np.unique(first[first < len(taken)])
        taken[won] = True
        known, low = _disjoint(top[a[won]], top[b[won]])
        up = np.arange(len(ids))
        up[known] = low
        top = up[top]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as those from each vertex to the smallest one that it reaches within its chunk."""
    for table in _chunks(batches):
        ids, low = _disjoint(table["a"].to_numpy(), table["b"].to_numpy())
        keep = ids != low
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(low[keep])], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk's edges (i, j, w, ci, cj) the lightest forest over ci, cj: a lightest forest of the whole has no other."""
    for table in _chunks(batches):
        order = pc.sort_indices(table, [("w", "ascending"), ("i", "ascending"), ("j", "ascending")], null_placement="at_start")
        table = table.take(order)
        keep = _lightest(table["ci"].to_numpy(), table["cj"].to_numpy())
        yield from table.take(pa.array(keep)).combine_chunks().to_batches()


def _merged(made: Rounds, edges: DataFrame, contract: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[DataFrame, int]:
    """Edges that partitions have contracted on their own, and how many are left: while they don't fit a task, as many as do
    are contracted together, as long as that halves them. A chunk keeps fewer edges than it has vertices, so what is left
    of a graph with few vertices fits a task after a few passes, and no rounds are needed."""
    m = edges.count()
    while m > CHUNK:
        edges = made.write(edges.coalesce(-(-m // CHUNK)).mapInArrow(contract, edges.schema))
        before, m = m, edges.count()
        if m > before // 2:
            break
    return edges, m


def components(links: DataFrame) -> DataFrame:
    """links: a, b, whole numbers. One row per vertex that has a link: `v`, `component` (the smallest vertex it reaches).

    Each partition sends on a star for each set of vertices that its own links connect, so that no more edges than vertices
    leave it; chunks of these are contracted again while that halves them. If they fit a task, it finishes; else each round takes the smallest label among neighbours and then the label
    of that label, so the number of rounds grows with the logarithm of the longest path.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    made = Rounds(links.sparkSession, "stars")
    links, left = _merged(made, made.write(links.mapInArrow(_stars, "a long, b long")), _stars)
    if left <= CHUNK:

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = list(_chunks(batches))
            if tables:
                table = pa.concat_tables(tables)
                ids, low = _disjoint(table["a"].to_numpy(), table["b"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["v", "component"])

        return materialise(links.coalesce(1).mapInArrow(finish, "v long, component long"), "labels")
    both = links.distinct()
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l"))
    labels = materialise(labels, "labels")
    seen, made = Rounds(links.sparkSession, "neighbours"), Rounds(links.sparkSession, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("n"))
        better = seen.write(labels.join(near, "v").select("v", "l", F.least("l", "n").alias("m")))
        up = better.select(F.col("v").alias("m"), F.col("m").alias("j"))
        moved = made.write(better.join(up, "m").select("v", F.col("j").alias("l"), (F.col("j") != F.col("l")).alias("moved")))
        labels = moved.select("v", "l")
        if moved.where("moved").isEmpty():
            return labels.withColumnRenamed("l", "component")


def all_components(a: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same for all vertices (v); one without links is its own component. Directions don't count."""
    found = components(a.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return vertices.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def bfs(a: DataFrame, roots: DataFrame, directed: bool = False) -> DataFrame:
    """v, level, parent (the smallest neighbour one level up; null at roots). Only reached vertices."""
    steps = a.select(F.col("i").alias("a"), F.col("j").alias("b")).where("a <> b")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    steps = materialise(steps.distinct(), "steps")
    # one table, a folder for each level: a level is written once and read as such, all levels are read for what is known
    path = f"{shared_dir(a.sparkSession)}/levels-{uuid.uuid4().hex}"
    front, level = roots.select(F.col("v"), F.lit(None).cast("long").alias("parent")).distinct(), 0
    kind = StructType([*front.schema.fields, StructField("level", IntegerType())])
    while True:
        front.write.parquet(f"{path}/level={level}")
        seen = a.sparkSession.read.schema(kind).option("basePath", path).parquet(path)
        front = seen.where(F.col("level") == level)
        if front.isEmpty():
            return seen.select("v", "level", "parent")
        level += 1
        reached = steps.join(front.select(F.col("v").alias("a")), "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent"))
        front = reached.join(seen, "v", "left_anti").select("v", "parent")


def spanning_forest(a: DataFrame, weight: str = "w") -> DataFrame:
    """A minimum spanning forest: rows i, j and the weight of undirected edges; ties go by i, then j.

    Each partition sends on the lightest forest of its own edges: what is heaviest on a ring of some edges is in no lightest
    forest of all, nor of what several partitions send on together. If what is left fits a task, it finishes; else every component takes its lightest edge to another one
    and the components so linked become one, of which there are half as many at most, and so on.
    """
    pairs = a.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col(weight).alias("w"))
    spark, kept, found = a.sparkSession, Rounds(a.sparkSession, "edges"), Rounds(a.sparkSession, "forest")
    edges = pairs.withColumns({"ci": F.col("i").cast("long"), "cj": F.col("j").cast("long")})
    kind = edges.schema
    edges, left = _merged(kept, kept.write(edges.mapInArrow(_forests, kind)), _forests)
    forest = spark.createDataFrame([], edges.select("i", "j", "w").schema)
    while left > CHUNK:
        both = edges.select("i", "j", "w", "ci", "cj", F.explode(F.array("ci", "cj")).alias("c"))
        lightest = both.groupBy("c").agg(F.min(F.struct("w", "i", "j", "ci", "cj")).alias("e")).select("e.*").distinct()
        lightest = materialise(lightest, "lightest")
        forest = found.write(forest.unionByName(lightest.select("i", "j", "w")))
        # components become single vertices; edges inside one are done with
        label = components(lightest.select(F.col("ci").alias("a"), F.col("cj").alias("b")))
        side = lambda c: label.select(F.col("v").alias(c), F.col("component").alias(f"n{c}"))  # noqa: E731, B023
        edges = edges.join(side("ci"), "ci").join(side("cj"), "cj").where("nci <> ncj")
        edges = edges.select("i", "j", "w", F.col("nci").alias("ci"), F.col("ncj").alias("cj"))
        edges, left = _merged(kept, kept.write(edges.mapInArrow(_forests, edges.schema)), _forests)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(_chunks(batches))
        if tables:
            yield from _forests(iter(pa.concat_tables(tables).combine_chunks().to_batches()))

    last = edges.coalesce(1).mapInArrow(finish, edges.schema).select("i", "j", "w")
    return materialise(forest.unionByName(last), "forest").withColumnRenamed("w", weight)


def _doubled(links: DataFrame, name: str) -> DataFrame:
    """links: id, next (null at the end of a list), w. id and the sum of w from each entry to the end of its list: each
    round every entry takes over what its next one knows, so rounds grow with the logarithm of the longest list."""
    made = Rounds(links.sparkSession, name)
    known = made.write(links.select("id", "next", "w"))
    while not known.where("next IS NOT NULL").isEmpty():
        further = known.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("w").alias("_w"))
        known = made.write(known.join(further, "next", "left").select("id", F.col("_next").alias("next"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))
    return known.select("id", "w")


#: The share of a forest's edges that must end in leaves for these to be taken off in a round of their own.
LEAVES = 0.125


def rooted(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """forest: i, j, the edges of trees; roots: v, one of each tree. v, parent (null at roots), size (of the subtree).

    Leaves are taken off round by round while they are many, so that the rounds of a shallow forest read a few times what
    its edges are; each takes the sizes of those below it along. What is left is rooted by tours.
    """
    spark, top, below = forest.sparkSession, roots.select("v"), []
    left, weights = Rounds(spark, "left"), Rounds(spark, "weights")
    edges = left.write(forest.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    held = weights.write(spark.createDataFrame([], "v long, s long"))
    while (m := edges.count()) > 0:
        ends = edges.select(F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("j").alias("u")), F.struct(F.col("j").alias("v"), F.col("i").alias("u")))).alias("e")).select("e.*")
        ends = ends.groupBy("v").agg(F.count("*").alias("d"), F.min("u").alias("parent")).where("d = 1")
        leaves = ends.join(top, "v", "left_anti").join(held, "v", "left").select("v", "parent", (1 + F.coalesce("s", F.lit(0))).alias("size"))
        leaves = materialise(leaves, "leaves")
        if leaves.count() < LEAVES * m:
            break
        below.append(leaves)
        off = leaves.select("v")
        edges = left.write(edges.join(off.withColumnRenamed("v", "i"), "i", "left_anti").join(off.withColumnRenamed("v", "j"), "j", "left_anti"))
        more = held.join(off, "v", "left_anti").unionByName(leaves.select(F.col("parent").alias("v"), F.col("size").alias("s")))
        held = weights.write(more.groupBy("v").agg(F.sum("s").alias("s")))
    if m:
        below.append(_toured(edges, roots, held))
    under = held  # of roots: what was taken off right below them; tours add the rest
    if m:
        own = below[-1].groupBy(F.col("parent").alias("v")).agg(F.sum("size").alias("s"))
        under = under.unionByName(own).groupBy("v").agg(F.sum("s").alias("s"))
    found = top.join(under, "v", "left").select("v", F.lit(None).cast("long").alias("parent"), (1 + F.coalesce("s", F.lit(0))).alias("size"))
    for part in below:
        found = found.unionByName(part.select("v", "parent", "size"))
    return found


def _toured(forest: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """v, parent and size of all but the roots, as rooted has them. held: v, s: vertices below v that the forest lacks.

    A tour goes round each tree, from every arc to the one after its twin among its end's arcs; of an edge's two arcs the
    parent's comes first, and what the arcs to children from it to its twin weigh is the subtree. Places in tours and
    these sums are found by doubling.
    """
    both = forest.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(forest.select(F.col("j").alias("a"), F.col("i").alias("b")))
    arcs = materialise(number_rows(both, "a", "b", name="id"), "arcs")
    first = arcs.groupBy("a").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    around = arcs.join(first, "a").select("id", "a", "b", "first", F.when(F.col("id") == F.col("last"), F.col("first")).otherwise(F.col("id") + 1).alias("after"))
    twins = around.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("id").alias("twin"), F.col("first").alias("_first"), F.col("after").alias("next"))
    ends = roots.select(F.col("v").alias("b"), F.lit(True).alias("_root"))
    tour = arcs.join(twins, ["a", "b"]).join(ends, "b", "left")
    closes = F.col("_root") & (F.col("next") == F.col("_first"))
    tour = materialise(tour.select("id", "twin", "a", "b", F.when(~F.coalesce(closes, F.lit(False)), F.col("next")).alias("next"), F.lit(1).cast("long").alias("w")), "tour")
    place = _doubled(tour, "tour-places")
    twin = place.select(F.col("id").alias("twin"), F.col("w").alias("_w"))
    down = materialise(tour.select("id", "twin", "a", "b", "next").join(place, "id").join(twin, "twin").where("w > _w"), "down")
    if held.isEmpty():
        return down.select(F.col("b").alias("v"), F.col("a").alias("parent"), F.expr("(w - _w + 1) div 2").alias("size"))
    heavy = down.select("id", "b").join(held.withColumnRenamed("v", "b"), "b", "left").select("id", (1 + F.coalesce("s", F.lit(0))).alias("w"))
    sums = _doubled(tour.select("id", "next").join(heavy, "id", "left").select("id", "next", F.coalesce("w", F.lit(0)).cast("long").alias("w")), "tour-sums")
    after = sums.select(F.col("id").alias("twin"), F.col("w").alias("_w"))
    return down.select("id", "twin", "a", "b").join(sums, "id").join(after, "twin").select(F.col("b").alias("v"), F.col("a").alias("parent"), (F.col("w") - F.col("_w")).alias("size"))


def visited(tree: DataFrame) -> DataFrame:
    """tree: v, parent, size. Adds `pos`: the place in a preorder of its tree that visits smaller subtrees first, ties by
    vertex: pos(child) = pos(parent) + 1 + the sizes of the siblings before it, added up to the root by doubling."""
    before = Window.partitionBy("parent").orderBy("size", "v").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(1 + F.coalesce(F.sum("size").over(before), F.lit(0)))
    steps = materialise(tree.select("v", "parent", "size", step.cast("long").alias("w")), "steps")
    places = _doubled(steps.select(F.col("v").alias("id"), F.col("parent").alias("next"), "w"), "visits")
    return steps.select("v", "parent", "size").join(places.select(F.col("id").alias("v"), F.col("w").alias("pos")), "v")


def preorder(tree: DataFrame) -> DataFrame:
    """tree: v, level, parent, as bfs gives it. Adds `size` (of the subtree) and `pos`: the place in a preorder of its
    tree that visits smaller subtrees first, ties by vertex. In closed form, a level at a time, as the levels are known:
    pos(child) = pos(parent) + 1 + the sizes of the siblings before it. rooted and visited do it for trees of any depth."""
    tree = materialise(tree, "tree")
    depth = tree.agg(F.max("level")).first()[0]
    if depth is None:
        return tree.withColumn("size", F.lit(1).cast("long")).withColumn("pos", F.lit(0).cast("long"))
    sizes = None
    for level in range(depth, -1, -1):
        own = tree.where(F.col("level") == level)
        if sizes is None:
            now = own.select("v", F.lit(1).cast("long").alias("size"))
        else:
            below = last.join(tree.select("v", "parent"), "v").groupBy(F.col("parent").alias("v")).agg(F.sum("size").alias("s"))  # noqa: F821
            now = own.join(below, "v", "left").select("v", (1 + F.coalesce("s", F.lit(0))).alias("size"))
        last = materialise(now, "sizes")
        sizes = last if sizes is None else sizes.unionByName(last)
        if level % 8 == 0:
            sizes = materialise(sizes, "sizes")
    sized = materialise(tree.join(sizes, "v"), "sized")
    before = Window.partitionBy("parent").orderBy("size", "v").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_skip", F.when(F.col("level") > 0, F.coalesce(F.sum("size").over(before), F.lit(0))))
    sized = materialise(sized, "sized")
    placed = above = sized.where("level = 0").select("v", F.lit(0).cast("long").alias("pos"))
    for level in range(1, depth + 1):
        up = above.select(F.col("v").alias("parent"), F.col("pos").alias("_up"))
        above = materialise(sized.where(F.col("level") == level).join(up, "parent").select("v", (F.col("_up") + 1 + F.col("_skip")).alias("pos")), "placed")
        placed = placed.unionByName(above)
        if level % 8 == 0:
            placed = materialise(placed, "placed")
    return sized.drop("_skip").join(placed, "v")
