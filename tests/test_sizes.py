"""What grows with the input: tasks, not what one of them holds."""

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import matrix
from spindrift.operators import graph, linear_order, spmm
from spindrift.sources import files
from spindrift.storage import deal

KEYS = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_follow_the_rows(spark):
    held = lambda: [spark.conf.get(k) for k in KEYS]
    own = held()
    deal(spark, 1000)
    assert held() == own
    deal(spark, 36_000_000)
    assert held() == ["144", f"{16 << 20}b", f"{8 << 20}b"]
    deal(spark, 216_000_000)
    assert held()[0] == "864"
    deal(spark, 0)
    assert held() == own
    try:  # the session's own settings hold where they ask for more tasks, and whatever has set them since
        deal(spark, 36_000_000)
        for k, v in zip(KEYS, ("500", "1m", "7MB"), strict=True):
            spark.conf.set(k, v)
        deal(spark, 36_000_000)
        assert held() == ["500", "1m", "7MB"]
    finally:
        for k, v in zip(KEYS, own, strict=True):
            spark.conf.set(k, v)
        deal(spark, 0)
    assert held() == own


def test_folders_of_tiles_follow_the_entries(spark, tmp_path):
    """Not the rows of tiles, nor rows of tiles times tasks; a tile over several folders is read whole."""
    places = [(i, j) for i in range(400) for j in (i % 40, 40 + i % 3)] + [(5, 100 + k) for k in range(300)]
    a = spark.createDataFrame([(i, j, 1.0) for i, j in places], "i long, j long, v double").repartition(4)
    files.write_tile_catalogue(matrix.with_tiles(a, 4).select("i", "j", "v", "bi", "bj"), str(tmp_path / "few"))
    assert len(list((tmp_path / "few" / "tiles").rglob("*.parquet"))) == 1
    for size in (4, 1000):
        path = tmp_path / f"many{size}"
        files.write_tile_catalogue(matrix.with_tiles(a, size).select("i", "j", "v", "bi", "bj"), str(path), entries=200)
        assert 3 <= len(list((path / "tiles").rglob("*.parquet"))) <= 6
        whole = files.read_catalogued(spark, str(path), "entries > 0")
        assert sorted((r["i"], r["j"]) for r in whole.collect()) == sorted(places)
    assert files.read_catalogued(spark, str(path), f"entries = {len(places)}").count() == len(places)


def test_a_row_of_x_goes_to_a_row_of_tiles_once(spark):
    """However many columns there are: tiles of the same rows go together, up to a number of entries."""
    n, features = 9000, 3
    places = sorted({(i, (i * 37 + k * 2111) % n) for i in range(60) for k in range(12)} | {(7, j) for j in range(0, n, 4)})
    a = spark.createDataFrame([(i, j, float(i % 5 - j % 3)) for i, j in places], "i long, j long, v double")
    x = spark.range(n).where("id % 11 <> 3").selectExpr("id AS v", "array(float(id % 7), float(id % 5), 1f) AS x")
    want = {}
    for i, j in places:
        if j % 11 != 3:
            for f, y in enumerate((j % 7, j % 5, 1)):
                want[i, f] = want.get((i, f), 0.0) + (i % 5 - j % 3) * y
    for entries in (spmm.TASK_ENTRIES, 500):
        got = spmm.multiply_compressed(spmm.compressed_tiles(a, 64, 256), x, features, entries)
        assert got.dtypes == [("v", "bigint"), ("f", "int"), ("x", "double")]
        assert {(r["v"], r["f"]): r["x"] for r in got.collect()} == want
    small = spmm.compressed_tiles(a.where("i = 8"), 64, 256)
    assert "2" not in {str(r["count"]) for r in spmm.multiply_compressed(small, x, features).groupBy("v", "f").count().collect()}


def test_shallow_trees_are_rooted_leaf_by_leaf(spark, monkeypatch):
    """A star of stars has no tour; a long path with leaves on it has one, of what is left of it, with what was taken off."""
    toured = []
    monkeypatch.setattr(graph, "_toured", lambda forest, *rest, f=graph._toured: toured.append(forest.count()) or f(forest, *rest))
    star = [(0, k) for k in range(1, 6)] + [(k, 10 * k + x) for k in range(1, 6) for x in range(8)]
    path = [(1000 + k, 1001 + k) for k in range(20)] + [(1000 + k, 2000 + 10 * k + x) for k in range(20) for x in range(3)]
    for edges, root, tours in ((star, 0, []), (path, 1007, [19])):
        near = {}
        for i, j in edges:
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        order, parent = [root], {root: None}
        for v in order:
            for u in near[v]:
                if u != parent[v]:
                    parent[u] = v
                    order.append(u)
        size = dict.fromkeys(order, 1)
        for v in reversed(order[1:]):
            size[parent[v]] += size[v]
        found = graph.rooted(spark.createDataFrame(edges, "i long, j long"), spark.createDataFrame([(root,)], "v long")).collect()
        assert {r["v"]: (r["parent"], r["size"]) for r in found} == {v: (parent[v], size[v]) for v in order} and len(found) == len(order)
        assert toured == tours


def test_joins_of_a_large_graph_broadcast_small_tables_only(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(key)
    try:
        deal(spark, 6_000_000, joins=True)
        assert spark.conf.get(key) == f"{256 << 10}b"
        deal(spark, 6_000_000)
        assert spark.conf.get(key) == own
        spark.conf.set(key, "-1")  # none at all stays none
        deal(spark, 6_000_000, joins=True)
        assert spark.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, own)
        deal(spark, 0)
    assert spark.conf.get(key) == own


def _dense_graph(spark, n, m):
    rng = np.random.default_rng(n)
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, n, (m, 2)) if i != j})
    return spark.createDataFrame(pairs, "i long, j long").repartition(6)


def test_few_vertices_need_no_rounds(spark, monkeypatch):
    """What partitions send on is contracted together while that halves it: 6 forests of 39 edges fit tasks of 120."""
    monkeypatch.setattr(graph, "CHUNK", 120)
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, name="step", f=graph.materialise: written.append(name) or f(df, name))
    a = _dense_graph(spark, 40, 900).withColumn("w", (F.col("i") * 31 + F.col("j") * 17) % 101)
    forest = graph.spanning_forest(a)
    assert forest.count() == 39 and {r["component"] for r in graph.components(a.selectExpr("i AS a", "j AS b")).collect()} == {0}
    assert written == ["forest", "labels"]  # no table of a round


def test_a_tree_that_fits_a_task_is_walked_in_it(spark, monkeypatch):
    """A component of too many edges for a task, whose spanning tree fits one, is ordered without tours and doubling."""
    a, vertices = _dense_graph(spark, 60, 700), spark.range(62).withColumnRenamed("id", "v")
    order = lambda edges: {r["v"]: r["step"] for r in linear_order.component_order(a, vertices, "forest", edges).collect()}
    rooted, want = [], order(10**6)
    monkeypatch.setattr(linear_order, "rooted", lambda *x, f=linear_order.rooted: rooted.append(1) or f(*x))
    assert order(100) == want and not rooted
    assert order(20) == want and rooted == [1]
