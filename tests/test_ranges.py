"""Owners of values by ranges, and breadth-first levels in one table."""

import os

import numpy as np
import pytest

from spindrift.operators import exchange, graph


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_unequal_ranges_without_a_nested_loop(spark, monkeypatch, sent):
    monkeypatch.setattr(exchange, "MOST_SENT", sent)
    rng = np.random.default_rng(1)
    sizes = np.where(rng.random(10_000) < 0.02, 5000, rng.integers(0, 4, 10_000))
    lo = 7 + np.cumsum(sizes) - sizes
    ranges = spark.createDataFrame([(k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(lo, sizes, strict=True)) if k % 10], "part long, lo long, hi long")
    x = [*rng.integers(0, int(lo[-1]) + 20, 3000).tolist(), None, 0, 7, int(lo[-1] + sizes[-1])]
    got = exchange.with_owner(spark.createDataFrame([(v,) for v in x], "j long"), ranges, "j", "owner")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(v, k) for v in x if v is not None for k in [int(np.searchsorted(lo, v, "right")) - 1] if k >= 0 and k % 10 and v < lo[k] + sizes[k]]
    assert sorted(map(tuple, got.select("j", "owner").collect())) == sorted(want) and len(want) > 1000
    assert exchange.with_owner(spark.createDataFrame([(3,)], "j long"), ranges.limit(0), "j", "owner").count() == 0


def test_levels_of_a_path_leave_one_table(spark):
    from spindrift.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    edges = [(k, k + 1, 1.0) for k in range(40)] + [(0, 39, 1.0), (100, 101, 1.0)]
    found = graph.bfs(spark.createDataFrame(edges, "i long, j long, v double"), spark.createDataFrame([(0,)], "v long"), directed=True)
    want = {k: (k, k - 1 if k else None) for k in range(39)} | {39: (1, 0), 40: (2, 39)}
    assert {r["v"]: (r["level"], r["parent"]) for r in found.collect()} == want
    assert len(set(os.listdir(folder)) - before) == 2  # the steps and the levels
