"""Compressed sparse rows on disk."""

import json

import numpy as np
import pytest

from spindrift.sources import csr


def _matrix(spark, n, entries, seed):
    rng = np.random.default_rng(seed)
    places = {(int(i), int(j)) for i, j in zip(rng.integers(0, n, entries) ** 2 // n, rng.integers(0, n, entries), strict=True)} | {(n // 2, j) for j in range(n)}
    rows = [(i, j, float(i * 7 + j)) for i, j in sorted(places)]
    return rows, spark.createDataFrame(rows, "i long, j long, v double")


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_round_trip(spark, tmp_path, monkeypatch, parts):
    rows, a = _matrix(spark, 60, 400, parts)
    path = f"file://{tmp_path}/m"
    csr.write_csr(a, path)
    back = csr.read_csr(spark, path, parts)
    assert sorted(map(tuple, back.collect())) == rows and back.rdd.getNumPartitions() >= 0.8 * parts
    monkeypatch.setattr(csr, "BATCH", 5)  # in this process, so that rows begin and end within batches
    reader = csr.CsrReader({"path": path, "partitions": str(parts)})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b.column(c).to_pylist() for c in "ijv"), strict=True)]
    assert sorted(got) == rows
    some = csr.read_csr(spark, path, parts, (10, 31))
    assert sorted(map(tuple, some.collect())) == [r for r in rows if 10 <= r[0] < 31]
    csr.write_csr(a.where("i = 3"), path)  # overwritten: the slices before aren't listed any more
    assert sorted(map(tuple, csr.read_csr(spark, path).collect())) == [r for r in rows if r[0] == 3]


def test_a_partition_reads_its_own_bytes_only(spark, tmp_path):
    rows, a = _matrix(spark, 200, 3000, 1)
    csr.write_csr(a, f"{tmp_path}/m")
    reader = csr.CsrReader({"path": f"{tmp_path}/m", "partitions": "8"})
    read = []
    original = csr._Numbers.read
    try:
        csr._Numbers.read = lambda self, first, last: read.append(last - first) or original(self, first, last)
        parts = reader.partitions()
        read.clear()
        part = next(p for p in parts if p.last - p.first > 100)
        got = [r for b in reader.read(part) for r in zip(*(b.column(c).to_pylist() for c in "ijv"), strict=True)]
    finally:
        csr._Numbers.read = original
    assert len(got) == part.last - part.first and set(got) <= set(rows)
    assert sum(read) <= 2 * len(got) + 250 and len(parts) >= 8


def test_a_triple_of_npy_files(spark, tmp_path):
    dense = np.array([[0, 1, 0], [0, 0, 0], [2, 0, 3]], float)
    indices, data, indptr = [1, 0, 2], [1.0, 2.0, 3.0], [0, 1, 1, 3]
    for name, x in (("indptr", np.array(indptr, np.int32)), ("indices", np.array(indices, np.int32)), ("data", np.array(data, np.float32))):
        np.save(tmp_path / f"{name}.npy", x)
    got = csr.read_csr(spark, str(tmp_path), 2).collect()
    assert sorted(map(tuple, got)) == [(i, j, dense[i, j]) for i, j in zip(*np.nonzero(dense), strict=True)]


def test_nothing_and_unsorted(spark, tmp_path):
    empty = spark.createDataFrame([], "i long, j long, v double")
    csr.write_csr(empty, f"{tmp_path}/e")
    assert csr.read_csr(spark, f"{tmp_path}/e").collect() == [] and json.loads((tmp_path / "e/slices.json").read_text())["slices"] == []
    wrong = spark.createDataFrame([(2, 0, 1.0), (1, 0, 1.0)], "i long, j long, v double").coalesce(1)
    with pytest.raises(Exception, match="sorted"):
        wrong.write.format("csr").option("path", f"{tmp_path}/w").mode("append").save()
    assert not (tmp_path / "w/slices.json").exists()
