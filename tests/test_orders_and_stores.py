"""Weighted orders, small components, orders against chance, placements, the store of levels, catalogued tiles, watched writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import matrix
from spindrift.operators import linear_order, metrics, peel, spmm
from spindrift.sources import files, graphs
from spindrift.sources.level_store import LevelStore

DATA = "/root/testdata/sf0.001"


def _weighted(edges):
    """Breadth first from each component's smallest vertex, lighter edges first, by hand."""
    near = {}
    for (i, j), w in edges.items():
        near.setdefault(i, []).append((w, j))
        near.setdefault(j, []).append((w, i))
    step, seen = {}, set()
    for root in sorted(near):
        if root in seen:
            continue
        queue = [root]
        seen.add(root)
        for v in queue:
            for _, u in sorted(near[v]):
                if u not in seen:
                    seen.add(u)
                    queue.append(u)
        step |= {v: k for k, v in enumerate(queue)}
    return step


@pytest.mark.parametrize("task_edges", [10**6, 1])
def test_lighter_edges_are_walked_first(spark, task_edges):
    rng = np.random.default_rng(5)
    edges = {}
    for i, j in rng.integers(0, 40, (70, 2)).tolist():
        if i != j:
            edges[min(i, j), max(i, j)] = float(rng.integers(0, 3))
    rows = [(j, i, w) for (i, j), w in edges.items()] + [(i, j, w + 1) for (i, j), w in edges.items()] + [(3, 3, 0.0)]
    a, vertices = spark.createDataFrame(rows, "i long, j long, w double"), spark.range(40).withColumnRenamed("id", "v")
    got = linear_order.component_order(a, vertices, "levels", task_edges, 1, "w").collect()
    want = _weighted(edges)
    assert {r["v"]: r["step"] for r in got} == {v: want.get(v, 0) for v in range(40)}


def test_null_and_nan_weights_come_last(spark):
    a = spark.createDataFrame([(0, 1, None), (0, 2, float("nan")), (0, 3, 5.0), (0, 4, -1.0)], "i long, j long, w double")
    got = linear_order.component_order(a, spark.range(5).withColumnRenamed("id", "v"), "levels", weight="w").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["step"])] == [0, 4, 3, 1, 2]


@pytest.mark.parametrize("method", ["levels", "forest"])
def test_small_components_stand_by_id(spark, method):
    # a path 0-3-1-2 and a path 4-8-5-9-6
    a = spark.createDataFrame([(0, 3), (3, 1), (1, 2), (4, 8), (8, 5), (5, 9), (9, 6)], "i long, j long")
    for limit in (10**6, 1):
        got = linear_order.component_order(a, spark.range(10).withColumnRenamed("id", "v"), method, limit, 4).collect()
        step = {r["v"]: r["step"] for r in got}
        assert [step[v] for v in range(4)] == [0, 1, 2, 3]
        assert sorted(step[v] for v in (4, 5, 6, 8, 9)) == list(range(5)) and step[8] == 1


def test_orders_beat_chance_on_the_tree(spark):
    a, n = graphs.trade_tree(spark, DATA)
    a = a.cache()
    vertices = spark.range(n).withColumnRenamed("id", "v")
    chance = dict(enumerate(np.random.default_rng(3).permutation(n).tolist()))
    cost = {"chance": chance}
    for method in ("levels", "forest"):
        cost[method] = {r["v"]: r["pos"] for r in linear_order.linear_order(a, vertices, 4, method).collect()}
        assert sorted(cost[method].values()) == list(range(n))
    pairs = [(r["i"], r["j"]) for r in a.collect()]
    total = {k: sum(abs(p[i] - p[j]) for i, j in pairs) for k, p in cost.items()}
    assert total["forest"] < total["chance"] / 3 and total["levels"] < total["chance"]


def test_placements_find_a_moved_entry(spark):
    a = spark.createDataFrame([(k, (k * 7 + 1) % 30, 1.0) for k in range(30)], "i long, j long, v double")
    levels = peel.peel(spark, a, 30, 4, 3, block=True)
    assert peel.placements(levels).where("NOT placed OR NOT inside").isEmpty()
    assert peel.places_taken(levels).where("NOT as_vertex OR NOT as_place").isEmpty()
    moved = peel.Levels(levels.edges.withColumn("pi", F.when(F.col("i") == 5, (F.col("pi") + 1) % 30).otherwise(F.col("pi"))), levels.perm, levels.meta, 30)
    assert [r["i"] for r in peel.placements(moved).where("NOT placed").collect()] == [5]
    short = peel.Levels(levels.edges, levels.perm.where("NOT (level = 0 AND v = 7)"), levels.meta, 30)
    assert peel.places_taken(short).where("NOT as_vertex").count() == 1


def test_store_replaces_one_width_alone(spark, tmp_path):
    a = spark.createDataFrame([(k, (k * 11 + 3) % 40, float(k)) for k in range(40)], "i long, j long, v double")
    store = LevelStore(spark, str(tmp_path / "store"))
    rows = lambda levels: sorted(tuple(r) for r in levels.edges.select("level", "i", "j", "v").collect())
    long, band = peel.peel(spark, a, 40, 3, 4, block=True), peel.peel(spark, a, 40, 6, 2)
    store.put(long, 3, "block")
    store.put(band, 6, "band")
    assert rows(store.get(3, "block")) == rows(long) and rows(store.get(6, "band")) == rows(band)
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "store" / "edges" / "asked=6").rglob("*.parquet"))}
    one = peel.peel(spark, a, 40, 3, 1, block=True)
    store.put(one, 3, "block")
    assert rows(store.get(3, "block")) == rows(one) and store.get(3, "block").perm.count() == 40
    assert before == {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "store" / "edges" / "asked=6").rglob("*.parquet"))}
    assert [(r["asked"], r["levels"]) for r in store.known().orderBy("asked").collect()] == [(3, 1), (6, band.meta.count())]
    assert "PartitionFilters" in store.get(6, "band", 0).edges._jdf.queryExecution().executedPlan().toString()
    for wrong in ((4, "block", None), (3, "block", 1), (6, "block", None)):
        with pytest.raises(KeyError):
            store.get(*wrong)


def test_catalogued_tiles_prune_folders_at_run_time(spark, tmp_path):
    a = spark.createDataFrame([(i, j, 1.0) for i in range(0, 60, 3) for j in range(i % 7 + 1)], "i long, j long, v double")
    files.write_tile_catalogue(matrix.with_tiles(a, 8).select("i", "j", "v", "bi", "bj"), str(tmp_path))
    got = files.read_catalogued(spark, str(tmp_path), "entries > 9")
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    tiles = {}
    for r in a.collect():
        tiles.setdefault((r["i"] // 8, r["j"] // 8), []).append((r["i"], r["j"]))
    want = sorted(e for own in tiles.values() if len(own) > 9 for e in own)
    assert want and sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_steps_are_logged_by_their_writes(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (1, 0, -3.0), (1, 1, 1.0)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "v long, f int, x double")
    log = metrics.MetricLog(spark, "r")
    y = spmm.iterate(lambda x: spmm.multiply(a, x), x, 2, log=log)
    assert sorted((r["v"], r["x"]) for r in y.collect()) == [(0, -2.0), (1, -13.0)]
    got = {(r["iteration"], r["name"]): r["value"] for r in log.table().collect()}
    assert got == {(1, "rows"): 2.0, (1, "total"): 3.0, (1, "largest"): 4.0, (2, "rows"): 2.0, (2, "total"): -15.0, (2, "largest"): 13.0}


def test_entries_outside_a_mapping_and_short_files_are_refused(spark, tmp_path):
    mapping = spark.createDataFrame([(0, 1), (1, 0)], "old long, new long")
    good = spark.createDataFrame([(0, 1, 5.0)], "i long, j long, v double")
    assert [tuple(r) for r in matrix.relabel(good, mapping, 2).collect()] == [(1, 0, 5.0)]
    with pytest.raises(Exception, match="isn't in 0 to 1"):
        matrix.relabel(good.withColumn("j", F.lit(2)), mapping, 2).collect()
    path = tmp_path / "short.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 4.5\n2 2 1\n")
    with pytest.raises(ValueError, match="has 2 entries and says 3"):
        files.read_matrix_market(spark, str(path))
