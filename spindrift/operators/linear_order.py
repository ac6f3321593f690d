"""A linear order of a graph's vertices: hubs first, then what is left tree by tree, then vertices without edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrix import degrees
from ..storage import materialise, number_rows
from .graph import all_components, rooted, spanning_forest, visited

#: Edges of one component, up to which it is ordered inside one task; larger ones are ordered by distributed rounds.
TASK_EDGES = 500_000


def vertex_classes(a: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """v, d, rank and class: head (the `width` vertices of highest degree, ties by id), middle, or single (degree 0)."""
    known = vertices.join(degrees(a), "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d"))
    ranked = number_rows(known, F.desc("d"), F.asc("v"), name="rank")
    kind = F.when(F.col("rank") < width, "head").when(F.col("d") > 0, "middle").otherwise("single")
    return ranked.withColumn("class", kind)


def _adjacency(pdf: pd.DataFrame) -> dict[int, list[int]]:
    near: dict[int, set[int]] = {}
    for i, j in zip(pdf["i"].tolist(), pdf["j"].tolist(), strict=True):
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    return {v: sorted(us) for v, us in near.items()}


def _walk_levels(pdf: pd.DataFrame) -> list[int]:
    """Breadth first from the smallest vertex, along lighter edges first, then to smaller vertices."""
    near: dict[int, list[tuple[float, int]]] = {}
    for i, j, along in zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf["along"].tolist(), strict=True):
        near.setdefault(i, []).append((along, j))
        near.setdefault(j, []).append((along, i))
    order = [min(near)]
    seen = set(order)
    for v in order:
        for _, u in sorted(near[v]):
            if u not in seen:
                seen.add(u)
                order.append(u)
    return order


def _walk_tree(pdf: pd.DataFrame) -> list[int]:
    """A lightest spanning tree from its smallest vertex, parents first and smaller subtrees before larger ones."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    keep = []
    for i, j in pdf.sort_values(["w", "i", "j"])[["i", "j"]].itertuples(index=False):
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            keep.append((i, j))
    return _walk_down(pd.DataFrame(keep, columns=["i", "j"]))


def _walk_down(pdf: pd.DataFrame) -> list[int]:
    """A tree from its smallest vertex, parents first and smaller subtrees before larger ones."""
    near = _adjacency(pdf)
    root = min(near)
    order, parent = [root], {root: root}
    for v in order:
        for u in near[v]:
            if u != parent[v]:
                parent[u] = v
                order.append(u)
    size = dict.fromkeys(order, 1)
    for v in reversed(order[1:]):
        size[parent[v]] += size[v]
    out, todo = [], [root]
    while todo:
        v = todo.pop()
        out.append(v)
        todo += sorted((u for u in near[v] if u != parent[v]), key=lambda u: (size[u], u), reverse=True)
    return out


def _queue_order(edges: DataFrame, roots: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """v, step: what _walk_levels gives, in rounds. A level's vertices stand by the place of their earliest neighbour one
    level up, then by the edge from it, then by id. edges: i, j, along, component; roots: the components to order, by their smallest vertex v.
    A level needs the one before it whole, so task_edges plays no part."""
    steps = edges.select("component", F.col("i").alias("a"), F.col("j").alias("b"), "along")
    steps = materialise(steps.unionByName(steps.select("component", F.col("b").alias("a"), F.col("a").alias("b"), "along")), "steps")
    seen = front = materialise(roots.select("v", F.col("v").alias("component"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("nth")), "front")
    level = 0
    while not front.isEmpty():
        level += 1
        reached = steps.join(front.select(F.col("v").alias("a"), "nth"), "a").groupBy("component", F.col("b").alias("v")).agg(F.min(F.struct("nth", "along")).alias("up"))
        found = number_rows(reached.join(seen, "v", "left_anti"), "component", "up", "v", name="nth")
        front = materialise(found.select("v", "component", F.lit(level).alias("level"), "nth"), "front")
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = materialise(seen, "seen")
    placed = materialise(number_rows(seen, "component", "level", "nth"), "placed")
    first = placed.groupBy("component").agg(F.min("pos").alias("first"))
    return placed.join(first, "component").select("v", (F.col("pos") - F.col("first")).alias("step"))


def _tree_order(edges: DataFrame, roots: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """v, step: what _walk_tree gives. edges: i, j, w, component; roots: v, n (vertices of the component), tree (whether it is
    a tree already and so its own spanning tree). A spanning tree that a task can hold is walked in one, larger ones in rounds."""
    trees, others = (roots.where(c).select(F.col("v").alias("component")) for c in ("tree", "NOT tree"))
    forest = edges.join(trees, "component", "left_semi").select("i", "j")
    if not others.isEmpty():
        forest = forest.unionByName(spanning_forest(edges.join(others, "component", "left_semi")).select("i", "j"))
    few, many = (roots.where(F.coalesce(F.col("n") - 1 <= task_edges, F.lit(False)) == fits) for fits in (True, False))
    if few.isEmpty():
        return visited(rooted(forest, roots)).select("v", F.col("pos").alias("step"))
    forest = materialise(edges.join(forest, ["i", "j"], "left_semi").select("i", "j", "component"), "trees")
    of = lambda some: forest.join(some.select(F.col("v").alias("component")), "component", "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _walk_down(pdf)
        return pd.DataFrame({"v": found, "step": range(len(found))}, dtype="int64")

    steps = of(few).groupBy("component").applyInPandas(lambda pdf: walk(pdf), "v long, step long")
    if many.isEmpty():
        return steps
    return steps.unionByName(visited(rooted(of(many).select("i", "j"), many)).select("v", F.col("pos").alias("step")))


def component_order(
    a: DataFrame, vertices: DataFrame, method: str = "forest", task_edges: int = TASK_EDGES, base: int = 2, weight: str | None = None
) -> DataFrame:
    """v, component, step: the place inside its component. `forest`: preorder of a spanning tree of pseudo-random
    weights; `levels`: breadth first from the smallest vertex, along edges of smaller `weight` first (a column of a; of
    several entries of a pair the smallest counts, null and NaN come last), then to smaller vertices. Components of at
    most `base` vertices stand by id. A component of more edges than a task should hold gets the same order in
    distributed rounds."""
    walk, rounds = {"forest": (_walk_tree, _tree_order), "levels": (_walk_levels, _queue_order)}[method]
    last = F.lit(float("inf"))
    along = F.lit(0.0) if weight is None else F.coalesce(F.nanvl(F.col(weight).cast("double"), last), last)
    edges = a.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.min(along).alias("along"))
    task_edges = max(task_edges, base * (base - 1) // 2)  # so that a component of `base` vertices never needs rounds
    edges = materialise(edges, "edges")
    member = materialise(all_components(edges, vertices), "members")
    edges = materialise(edges.join(member.withColumnRenamed("v", "i"), "i"), "edges")
    vertices = member.groupBy("component").agg(F.count("*").alias("n"))
    sizes = edges.groupBy("component").agg(F.count("*").alias("m")).join(vertices, "component")
    sizes = materialise(sizes.select("component", "m", "n", (F.col("m") == F.col("n") - 1).alias("tree")), "sizes")
    edges = edges.withColumn("w", F.md5(F.concat_ws(":", "i", "j")))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [walk(own) if len(few := set(own["i"]) | set(own["j"])) > base else sorted(few) for _, own in pdf.groupby("component")]
        return pd.DataFrame({"v": [v for own in found for v in own], "step": [k for own in found for k in range(len(own))]}, dtype="int64")

    # small components share a task's call
    small = edges.join(sizes.where(F.col("m") <= task_edges).select("component"), "component", "left_semi")
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    calls = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // task_edges))
    steps = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(calls)).alias("call")).applyInPandas(lambda pdf: order(pdf), "v long, step long")
    large = sizes.where(F.col("m") > task_edges).select(F.col("component").alias("v"), "n", "tree")
    if not large.isEmpty():
        steps = steps.unionByName(rounds(edges.join(large.select(F.col("v").alias("component")), "component", "left_semi"), large, task_edges))
    return member.join(steps, "v", "left").select("v", "component", F.coalesce("step", F.lit(0)).alias("step"))


def linear_order(a: DataFrame, vertices: DataFrame, width: int, method: str = "forest", base: int = 2, weight: str | None = None) -> DataFrame:
    """v, pos: a bijection onto 0 to n - 1. Edges of head vertices are left out before the middle is ordered; its components
    stand by size, largest first, then by their smallest vertex. base, weight: as component_order has them."""
    classes = materialise(vertex_classes(a, vertices, width), "classes")
    middle = classes.where("class = 'middle'").select("v")
    inner = a.join(middle.withColumnRenamed("v", "i"), "i", "left_semi").join(middle.withColumnRenamed("v", "j"), "j", "left_semi")
    steps = materialise(component_order(inner, middle, method, base=base, weight=weight), "order")
    steps = steps.join(steps.groupBy("component").agg(F.count("*").alias("_size")), "component")
    keyed = classes.join(steps, "v", "left").select(
        "v",
        F.when(F.col("class") == "head", 0).when(F.col("class") == "middle", 1).otherwise(2).alias("_segment"),
        F.when(F.col("class") == "middle", F.col("component")).otherwise(F.col("rank")).alias("_group"),
        F.coalesce("_size", F.lit(0)).alias("_size"), F.coalesce("step", F.lit(0)).alias("_step"),
    )
    return number_rows(keyed, "_segment", F.desc("_size"), "_group", "_step", "v").select("v", "pos")
