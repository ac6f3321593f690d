"""Disjoint sets inside partitions, compressed tiles and a matrix that stays in place."""

import re

import numpy as np
import pytest

from spindrift.operators import graph, spmm


def _edges(seed, n, m):
    rng = np.random.default_rng(seed)
    return [(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3, rng.integers(0, 6, m), strict=True)]


def _kruskal(edges):
    top, out = {}, set()

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for w, i, j in sorted((w, min(i, j), max(i, j)) for i, j, w in edges if i != j):
        if find(i) != find(j):
            top[find(i)] = find(j)
            out.add((i, j, w))
    lowest = {}
    for v in list(top):
        lowest.setdefault(find(v), []).append(v)
    return out, {v: min(vs) for vs in lowest.values() for v in vs}


@pytest.mark.parametrize("chunk", [500_000, 3])
@pytest.mark.parametrize(("n", "m"), [(12, 9), (30, 200), (400, 330)])
def test_forest_and_components_equal_kruskal(spark, monkeypatch, chunk, n, m):
    monkeypatch.setattr(graph, "CHUNK", chunk)  # of the driver: with 3, rounds go on until three edges are left
    edges = _edges(n + m, n, m)
    edges += edges[: m // 4]
    forest, low = _kruskal(edges)
    a = spark.createDataFrame(edges, "i long, j long, w double").repartition(5)
    assert sorted(map(tuple, graph.spanning_forest(a).select("i", "j", "w").collect())) == sorted(forest)
    assert {r["v"]: r["component"] for r in graph.components(a.selectExpr("i AS a", "j AS b")).collect()} == low
    assert graph.components(a.selectExpr("i AS a", "j AS b").limit(0)).count() == 0


def test_a_partition_sends_on_no_more_than_a_forest():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 100, (2, 5000))
    ids, low = graph._disjoint(a, b)
    assert list(ids) == sorted({*a.tolist(), *b.tolist()}) and set(low.tolist()) == {0}
    assert len(graph._lightest(a, b)) == 99
    path = np.arange(100_000)
    assert not graph._disjoint(path[:-1], path[1:])[1].any() and len(graph._lightest(path[:-1], path[1:])) == 99_999


@pytest.mark.parametrize("size", [(4, 3), (1024, 2048)])
def test_compressed_tiles_multiply(spark, size):
    rng = np.random.default_rng(7)
    places = sorted({(int(i), int(j)) for i, j in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), strict=True)} | {(5, j) for j in range(40)})
    a = spark.createDataFrame([(i, j, float(i - j + 0.5)) for i, j in places], "i long, j long, v double")
    x = {v: rng.integers(-3, 4, 5).astype(float) for v in range(40) if v % 7}  # some rows are absent
    tiles = spmm.compressed_tiles(a, *size)
    got = {(r["v"], r["f"]): r["x"] for r in spmm.multiply_compressed(tiles, spark.createDataFrame([(v, row.tolist()) for v, row in x.items()], "v long, x array<float>"), 5).collect()}
    want = {}
    for i, j in places:
        for f in range(5):
            if j in x:
                want[i, f] = want.get((i, f), 0.0) + (i - j + 0.5) * x[j][f]
    assert got == want and tiles.count() == len({(i // size[0], j // size[1]) for i, j in places})
    assert spmm.multiply_compressed(tiles.limit(0), spark.createDataFrame([], "v long, x array<float>"), 5).count() == 0


def test_a_stays_where_it_is(spark):
    edges = [(i, (i * 7 + k) % 50, float(k + 1)) for i in range(50) for k in range(4)]
    a = spark.createDataFrame(edges, "i long, j long, v double")
    dense = np.zeros((50, 50))
    for i, j, v in edges:
        dense[i, j] += v
    x = np.arange(100).reshape(50, 2) % 9
    frame = spark.createDataFrame([(v, *map(float, x[v])) for v in range(50)], "v long, f0 double, f1 double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = spmm.Stationary(a)
        product = kept.product(kept.keep(frame))
        again = kept.product(kept.keep(product, dealt=True))
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the one exchange stands above the join, for the sums; neither A nor X is shuffled for it
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and plan.index("Exchange") < plan.index("SortMergeJoin")
    kept.close()
    got = {r["v"]: (r["f0"], r["f1"]) for r in spmm.iterate_stationary(a, frame, 3).collect()}
    assert got == {v: tuple(row) for v, row in enumerate((dense @ dense @ dense @ x).tolist())}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stationary")]
