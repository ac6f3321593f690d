"""Operators on small matrices: edge cases, invariants on random graphs, files, streams."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import matrix as M
from spindrift.operators import exchange, graph, linear_order, metrics, peel, spmm
from spindrift.sources import files, generators, graphs
from spindrift.storage import number_rows, sums_before

SOME = settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def matrix(spark, entries):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in entries], "i long, j long, v double")


def product(entries, x):
    out = {}
    for i, j, v in entries:
        for f, y in enumerate(x[j]):
            out[i, f] = out.get((i, f), 0) + v * y
    return out


def rows_x(spark, x):
    return spark.createDataFrame([(v, f, float(y)) for v, r in enumerate(x) for f, y in enumerate(r)], "v long, f int, x double")


def as_dict(df):
    return {(r["v"], r["f"]): r["x"] for r in df.collect()}


@SOME
@given(st.integers(4, 24), st.integers(0, 60), st.integers(0, 999), st.booleans(), st.booleans())
def test_peel_of_random_graphs(spark, n, m, seed, block, prune):
    rng = random.Random(seed)
    entries = list({(rng.randrange(n), rng.randrange(n)): rng.choice([-2, 1, 3]) for _ in range(m)}.items())
    entries = [(i, j, v) for (i, j), v in entries]
    a = matrix(spark, entries)
    levels = peel.peel(spark, a, n, max(1, n // 4), 3, block, prune)
    assert {r["rule"]: r["errors"] for r in peel.invariants(levels, a).collect()} == dict.fromkeys(["union_equals_input", "levels_disjoint", "permutations_bijective", "structure"], 0)
    x = [[(v * 7 + f * 3) % 11 for f in range(2)] for v in range(n)]
    assert as_dict(spmm.multiply_levels(levels, rows_x(spark, x))) == product(entries, x)


@pytest.mark.parametrize("entries,n", [([], 3), ([(0, 0, 1)], 1), ([(0, 0, 1), (2, 2, 5)], 3), ([(0, k, 1) for k in range(1, 9)], 9), ([(k, k + 1, 1) for k in range(8)], 9)])
def test_peel_edge_cases(spark, entries, n):
    a = matrix(spark, entries)
    for width in (1, n):
        levels = peel.peel(spark, a, n, width, 2)
        assert sorted(map(tuple, levels.edges.select("i", "j", "v").collect())) == sorted((i, j, float(v)) for i, j, v in entries)
        assert all(r["errors"] == 0 for r in peel.invariants(levels, a).collect())


def test_products_agree(spark):
    rng = random.Random(3)
    n = 40
    entries = [(i, j, rng.randint(-3, 3)) for i in range(n) for j in rng.sample(range(n), 5)]
    a, x = matrix(spark, entries), [[rng.randint(-5, 5) for _ in range(3)] for _ in range(n)]
    xs, want = rows_x(spark, x), product(entries, x)
    plans = [
        spmm.multiply(a, xs), spmm.multiply_tiles(a, xs, 7), spmm.multiply_owned(a, xs, 7), spmm.multiply_replicated(a, xs, n, 8, 2),
        spmm.multiply_replicated(a, xs, n, 1, 1), spmm.multiply_slices(a, xs, exchange.even_ranges(spark, n, 3)),
    ]
    for got in plans:
        assert as_dict(got) == want
    wide = spark.createDataFrame([(v, *map(float, r)) for v, r in enumerate(x)], "v long, a double, b double, c double")
    got = {(r["v"], f): r[k] for r in spmm.multiply_wide(a, wide, ["a", "b", "c"], group=2).collect() for f, k in enumerate("abc")}
    assert got == want
    with pytest.raises(ValueError):
        spmm.multiply_replicated(a, xs, n, 6, 4)


def test_iterated(spark):
    entries = [(0, 1, 2), (1, 2, 1), (2, 0, 3)]
    a = matrix(spark, entries)
    x = [[1], [2], [3]]
    for _ in range(5):
        x = [[product(entries, x).get((v, 0), 0)] for v in range(3)]
    assert as_dict(spmm.iterate(lambda y: spmm.multiply(a, y), rows_x(spark, [[1], [2], [3]]), 5)) == {(v, 0): float(r[0]) for v, r in enumerate(x)}


def kruskal(edges):
    """The lightest forest of (w, i, j), ties by i, then j: every edge in order whose ends aren't joined yet."""
    label, kept = {}, []
    for w, i, j in sorted(edges):
        a, b = label.setdefault(i, i), label.setdefault(j, j)
        if a != b:
            kept.append((i, j, w))
            label.update({v: a for v, x in label.items() if x == b})
    return kept


def smaller_first(edges, root):
    """A preorder of a tree that goes into smaller subtrees first, ties by vertex; with parents and sizes."""
    near = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)

    def below(v, up):
        found = sorted((len(x), x[0][0], x) for x in (below(u, v) for u in near.get(v, []) if u != up))
        return [(v, up, 1 + sum(n for n, _, _ in found)), *(e for _, _, x in found for e in x)]

    return below(root, None)


def parts(vertices, edges):
    label = {v: v for v in vertices}
    for _ in vertices:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("n,m,seed", [(30, 30, 1)])
def test_forests_and_orders_by_brute_force(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    edges = [(rng.randrange(5) / 2, i, j) for i, j in pairs]
    a = spark.createDataFrame([(j, i, w) if rng.random() < 0.5 else (i, j, w) for w, i, j in edges], "i long, j long, w double")
    want = kruskal(edges)
    assert sorted(tuple(r) for r in graph.spanning_forest(a).select("i", "j", "w").collect()) == sorted(want)
    assert graph.spanning_forest(a.limit(0)).count() == 0
    label = parts(range(n), pairs)
    roots = sorted(set(label.values()))
    tours = {r: smaller_first([(i, j) for i, j, _ in want if label[i] == r], r) for r in roots}
    tree = graph.visited(graph.rooted(a.join(spark.createDataFrame([(min(i, j), max(i, j)) for i, j, _ in want], "x long, y long"), (F.least("i", "j") == F.col("x")) & (F.greatest("i", "j") == F.col("y"))).select("i", "j"), spark.createDataFrame([(r,) for r in roots], "v long")))
    assert {r["v"]: (r["parent"], r["size"], r["pos"]) for r in tree.collect()} == {v: (p, s, k) for t in tours.values() for k, (v, p, s) in enumerate(t)}
    # the same trees by their pseudo-random weights, and breadth first, as the linear order takes them
    import hashlib

    hashed = kruskal([(hashlib.md5(f"{i}:{j}".encode()).hexdigest(), i, j) for i, j in pairs])
    forest = {v: k for r in roots for k, (v, _, _) in enumerate(smaller_first([(i, j) for i, j, _ in hashed if label[i] == r], r))}
    levels = {}
    for r in roots:
        queue = [r]
        for v in queue:
            queue += sorted(u for u in {x for e in pairs if v in e for x in e} - {v} if u not in queue)
        levels |= {v: k for k, v in enumerate(queue)}
    vertices = spark.range(n).withColumnRenamed("id", "v")
    for method, step in (("forest", forest), ("levels", levels)):
        for limit in (10**6, 1):
            got = linear_order.component_order(a.select("i", "j"), vertices, method, limit).collect()
            assert {r["v"]: (r["component"], r["step"]) for r in got} == {v: (label[v], step[v]) for v in range(n)}


def test_linear_order_puts_hubs_first_then_large_components(spark):
    rng = random.Random(8)
    pairs = {(0, k) for k in range(1, 20)} | {(30 + k, 31 + k) for k in range(5)} | {(50 + k, 51 + k) for k in range(9)} | {tuple(sorted(rng.sample(range(1, 20), 2))) for _ in range(6)}
    a, n = matrix(spark, [(i, j, 1) for i, j in pairs]), 65
    place = {r["v"]: r["pos"] for r in linear_order.linear_order(a, spark.range(n).withColumnRenamed("id", "v"), 1).collect()}
    assert sorted(place.values()) == list(range(n)) and place[0] == 0
    inner = [e for e in pairs if 0 not in e]
    degree = {v: sum(v in e for e in pairs) for v in range(n)}
    label = parts(range(n), inner)
    middle = sorted((v for v in range(1, n) if degree[v]), key=place.get)
    size = {c: sum(label[v] == c for v in middle) for c in set(label.values())}
    assert [place[v] for v in middle] == list(range(1, len(middle) + 1))
    assert [label[v] for v in middle] == sorted((label[v] for v in middle), key=lambda c: (-size[c], c))
    # neighbours stand nearer than in a random order
    spread = lambda at: sum(abs(at[i] - at[j]) for i, j in inner)
    mixed = dict(zip(range(n), rng.sample(range(n), n), strict=True))
    assert spread(place) < spread(mixed) / 2


def test_deep_tree(spark):
    n = 40
    tree = graph.visited(graph.rooted(spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")), spark.createDataFrame([(0,)], "v long")))
    assert all(r["pos"] == r["v"] and r["size"] == n - r["v"] for r in tree.collect())


def test_relabel_refuses_what_is_no_bijection(spark):
    a = matrix(spark, [(0, 1, 2), (2, 0, 1)])
    good = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old long, new long")
    assert sorted(map(tuple, M.relabel(a, good, 3).collect())) == [(1, 2, 1.0), (2, 0, 2.0)]
    for bad in ([(0, 2), (1, 0)], [(0, 2), (1, 2), (2, 1)], [(0, 2), (1, 0), (2, 3)], [(0, 2), (0, 1), (2, 0)]):
        with pytest.raises(ValueError):
            M.relabel(a, spark.createDataFrame(bad, "old long, new long"), 3)


@pytest.mark.parametrize("method", ["forest"])
def test_order_is_the_same_in_a_task_and_in_rounds(spark, method):
    rng = random.Random(5)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(40 + rng.randrange(9), 40 + rng.randrange(9)) for _ in range(14)} | {(60 + k, 61 + k) for k in range(11)}
    a, v = matrix(spark, [(i, j, 1) for i, j in pairs]), spark.range(80).withColumnRenamed("id", "v")
    found = [sorted(map(tuple, linear_order.component_order(a, v, method, limit).collect())) for limit in (10**6, 1)]
    assert found[0] == found[1]


def test_long_path_is_one_component(spark):
    n = 300
    a = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(a).select("component").distinct().collect()[0][0] == 0


def test_number_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r["k"] == r["pos"] for r in number_rows(df, "k").collect())
    assert number_rows(df.limit(0), "k").count() == 0


def test_sums_before(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(0.5).alias("w"))
    rows = sums_before(df, ["k", "w"], F.desc("k")).collect()
    assert len(rows) == 1000 and all(r["before_w"] == (999 - r["k"]) / 2 and r["before_k"] == sum(range(r["k"] + 1, 1000)) for r in rows)
    assert sums_before(df.limit(0), ["k"], "k").count() == 0


def test_files(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 1.5\n3 2 4\n")
    a, rows, columns = files.read_matrix_market(spark, str(path))
    assert (rows, columns) == (3, 3)
    assert sorted(map(tuple, a.collect())) == [(0, 0, 2.0), (0, 1, 1.5), (1, 0, 1.5), (1, 2, 4.0), (2, 1, 4.0)]
    path.write_text("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n")
    a, rows, columns = files.read_matrix_market(spark, str(path))
    assert (rows, columns) == (2, 3) and sorted(map(tuple, a.collect())) == [(0, 2, 1.0), (1, 0, 1.0)]
    levels = peel.peel(spark, a.unionByName(M.transpose(a)), 3, 1, 2)
    files.write_levels(levels, str(tmp_path / "levels"))
    back = files.read_levels(spark, str(tmp_path / "levels"))
    assert back.n == 3 and files.level_count(spark, str(tmp_path / "levels")) == levels.meta.count()
    assert sorted(map(tuple, back.edges.select("level", "pi", "pj", "i", "j", "v").collect())) == sorted(map(tuple, levels.edges.collect()))
    assert files.read_levels(spark, str(tmp_path / "levels"), 0).perm.count() == 3
    tiles = M.with_tiles(generators.structured(spark, 12, 2), 4)
    files.write_tiles(tiles, str(tmp_path / "tiles"))
    assert files.read_tile(spark, str(tmp_path / "tiles"), 1, 0).count() == tiles.where("bi = 1 AND bj = 0").count() > 0


def test_entry_like_the_size_line(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate integer general\n3 3 3\n1 1 2\n2 1 5\n3 3 3\n")
    a, rows, columns = files.read_matrix_market(spark, str(path))
    assert (rows, columns) == (3, 3)
    assert sorted(map(tuple, a.collect())) == [(0, 0, 2.0), (1, 0, 5.0), (2, 2, 3.0)]


def test_kinds_of_files(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 2\n2 1 1.5\n3 1 -2\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, str(path))[0].collect())) == [(0, 1, -1.5), (0, 2, 2.0), (1, 0, 1.5), (2, 0, -2.0)]
    for kind in ("complex general", "complex hermitian"):
        path.write_text(f"%%MatrixMarket matrix coordinate {kind}\n1 1 1\n1 1 1 0\n")
        with pytest.raises(ValueError):
            files.read_matrix_market(spark, str(path))


def test_wide_products_of_arrays(spark):
    a = matrix(spark, [(0, 1, 2), (0, 0, 1), (2, 1, -1)])
    x = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "v long, x array<float>")
    assert as_dict(spmm.multiply_arrays(a, x, 3)) == {(0, 0): 9.0, (0, 1): 12.0, (0, 2): 15.0, (2, 0): -4.0, (2, 1): -5.0, (2, 2): -6.0}


def test_steps_of_a_hot_type_need_no_window_over_it(spark, tmp_path):
    rows = [(k, k * 7 % 10, "hot" if k % 5 else ("b" if k % 2 else None), k // 3) for k in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts long").write.parquet(str(tmp_path / "events.parquet"))
    a, n = graphs.user_steps(spark, str(tmp_path))
    assert "Window" not in a._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for t in ("hot", "b", None):
        users = [u for _, u, x, _ in sorted(rows, key=lambda r: (r[3], r[0])) if x == t]
        for e in zip(users, users[1:]):
            want[e] = want.get(e, 0) + 1
    assert {(r["i"], r["j"]): r["v"] for r in a.collect()} == want and n == 10


def test_generators(spark):
    g = generators.uniform(spark, 200, 6.0)
    assert g.count() > 400 and g.where("i >= j").isEmpty()
    hubs = M.degrees(generators.attachment(spark, 300, 3)).orderBy(F.desc("d")).first()
    assert hubs["v"] < 30


def test_metrics(spark, tmp_path):
    log = metrics.MetricLog(spark, "r1")
    for k in range(3):
        log.set_iteration(k)
        log.log(time=float(k))
    log.flush(str(tmp_path / "m"))
    kept = spark.read.parquet(str(tmp_path / "m"))
    assert tuple(metrics.runtime_stats(kept).first())[:3] == ("time", 3, 1.0)
    y = spark.createDataFrame([(0, 0, 1.0)], "v long, f int, x double")
    assert metrics.error_norms(y, y.limit(0)).first()["max_abs"] == 1.0


def test_streaming(spark, tmp_path):
    from spindrift.streaming.products import streaming_degrees, streaming_product

    entries = [(0, 1, 2.0), (1, 0, 1.0), (0, 1, 3.0)]
    for k, e in enumerate(entries):
        spark.createDataFrame([(*e, k)], "i long, j long, v double, k long").selectExpr("i", "j", "v", "timestamp_seconds(k * 100) AS t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, v double, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    x = rows_x(spark, [[1], [10]])
    q = streaming_product(stream, x).writeStream.outputMode("complete").format("memory").queryName("products").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["v"], r["f"]): r["x"] for r in spark.sql("SELECT * FROM products").collect()} == {(0, 0): 50.0, (1, 0): 1.0}
    q = streaming_degrees(stream, "t", "1 hour", "1 minute").writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert {r["v"]: r["d"] for r in spark.sql("SELECT * FROM degrees").collect()} == {0: 3, 1: 3}
