"""Matrices as compressed sparse rows on disk: a Spark data source that reads and writes them in slices.

A folder holds slices, each of three files of little-endian numbers: `indptr` (where each row of the slice begins),
`indices` (columns) and `data` (values). `slices.json`, written last, lists them. A folder without it may hold one triple
of .npy files: `indptr.npy`, `indices.npy` and `data.npy`, from row 0. Files are opened by URI, so any store that pyarrow
knows and all executors reach will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.matrix import canonical

#: Entries that a batch holds, and rows of indptr that are read at once.
BATCH = 1 << 16
SCHEMA = "i long, j long, v double"
_PARTS = ("indptr", "indices", "data")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Numbers:
    """Numbers of a file, read by place."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file, self.start, self.kind = store.open_input_file(path), 0, np.dtype("<f8" if path.endswith("data") else "<i8")
        if path.endswith(".npy"):
            version = np.lib.format.read_magic(self.file)
            shape, _, self.kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(self.file)
            self.start, self.size = self.file.tell(), shape[0]
        else:
            self.size = self.file.size() // self.kind.itemsize

    def read(self, first: int, last: int) -> np.ndarray:
        self.file.seek(self.start + first * self.kind.itemsize)
        return np.frombuffer(self.file.read((last - first) * self.kind.itemsize), self.kind)

    def last_not_over(self, value: int) -> int:
        """The last place whose number isn't over the value, in ascending numbers: a binary search by seeks."""
        low, high = 0, self.size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.read(middle, middle + 1)[0] <= value else (low, middle)
        return low


@dataclass
class Slice(InputPartition):
    """Entries first to last (not included) of a slice that begins at row `row`."""

    files: tuple[str, str, str]
    row: int
    first: int
    last: int


def _slices(path: str) -> list[dict]:
    store, root = _open(path)
    if store.get_file_info(f"{root}/slices.json").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/slices.json") as file:
            return json.loads(file.read())["slices"]
    indptr = _Numbers(store, f"{root}/indptr.npy")
    if not indptr.size:
        return []
    return [{"files": [f"{p}.npy" for p in _PARTS], "row": 0, "entries": int(indptr.read(indptr.size - 1, indptr.size)[0])}]


class CsrReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.rows = [int(options[k]) if k in options else None for k in ("from", "to")]

    def partitions(self) -> list[Slice]:
        """Byte ranges of `indices`, about as many as asked for; with rows given, of these rows' entries only."""
        store, root = _open(self.path)
        found = []
        for s in _slices(self.path):
            first, last = 0, s["entries"]
            if self.rows != [None, None]:
                indptr = _Numbers(store, f"{root}/{s['files'][0]}")
                place = lambda row, s=s, indptr=indptr: int(indptr.read(k := min(max(row - s["row"], 0), indptr.size - 1), k + 1)[0])
                first, last = 0 if self.rows[0] is None else place(self.rows[0]), last if self.rows[1] is None else place(self.rows[1])
            found.append((s, first, last))
        step = max(1, -(-sum(max(0, last - first) for _, first, last in found) // self.parts))
        return [Slice(tuple(s["files"]), s["row"], k, min(k + step, last)) for s, first, last in found for k in range(first, last, step)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there are none
            return
        store, root = _open(self.path)
        indptr, indices, data = (_Numbers(store, f"{root}/{f}") for f in partition.files)
        row = indptr.last_not_over(partition.first)
        for first in range(partition.first, partition.last, BATCH):
            last, starts, at = min(first + BATCH, partition.last), [], row
            while at < indptr.size:  # where rows of the batch begin
                starts.append(indptr.read(at, min(at + BATCH, indptr.size)))
                at += len(starts[-1])
                if starts[-1][-1] >= last:
                    break
            own = row + np.searchsorted(np.concatenate(starts), np.arange(first, last), "right") - 1
            row = int(own[-1])
            arrays = [pa.array(own + partition.row), pa.array(indices.read(first, last).astype(np.int64)), pa.array(data.read(first, last).astype(float))]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "v"])


@dataclass
class Written(WriterCommitMessage):
    """The slice that a task has written; None if it had no rows."""

    slice: dict | None


class CsrWriter(DataSourceArrowWriter):
    """Each task writes a slice under a name of its own; the commit lists those of the tasks that count, so that neither
    a failed attempt's files nor a half-written matrix are ever read."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name, row, at, entries = uuid.uuid4().hex, None, -1, 0
        files = [f"{name}.{p}" for p in _PARTS]
        with store.open_output_stream(f"{root}/{files[0]}") as indptr, store.open_output_stream(f"{root}/{files[1]}") as indices, store.open_output_stream(f"{root}/{files[2]}") as data:
            for batch in iterator:
                i, j, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v"))
                if not len(i):
                    continue
                if (np.diff(i, prepend=at if at >= 0 else i[0]) < 0).any():
                    raise ValueError("rows must be sorted within partitions")
                if row is None:
                    row, at = int(i[0]), int(i[0]) - 1
                # a row begins where the first entry of it or of a later one stands
                for low in range(at + 1, int(i[-1]) + 1, BATCH):
                    rows = np.arange(low, min(low + BATCH, int(i[-1]) + 1))
                    indptr.write((entries + np.searchsorted(i, rows)).astype("<i8").tobytes())
                at = int(i[-1])
                indices.write(j.astype("<i8").tobytes())
                data.write(v.astype("<f8").tobytes())
                entries += len(i)
            indptr.write(np.array([entries], "<i8").tobytes())
        return Written({"files": files, "row": row, "entries": entries} if entries else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        before = [] if self.overwrite or store.get_file_info(f"{root}/slices.json").type != fs.FileType.File else _slices(self.path)
        new = [m.slice for m in messages if m is not None and m.slice]
        with store.open_output_stream(f"{root}/slices.json.new") as file:
            file.write(json.dumps({"slices": before + sorted(new, key=lambda s: s["row"])}).encode())
        store.move(f"{root}/slices.json.new", f"{root}/slices.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for name in m.slice["files"] if m is not None and m.slice else []:
                store.delete_file(f"{root}/{name}")


class CsrSource(DataSource):
    """Options: path; partitions; from, to: the rows to read (to isn't included)."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(dict(self.options), overwrite)


def write_csr(a: DataFrame, path: str) -> None:
    """(i, j, v), places from 0, as slices by ranges of (row, column); a row of very many entries is in several."""
    a.sparkSession.dataSource.register(CsrSource)
    entries = canonical(a).selectExpr("cast(i AS long) AS i", "cast(j AS long) AS j", "cast(v AS double) AS v")
    entries.repartitionByRange("i", "j").sortWithinPartitions("i", "j").write.format("csr").option("path", path).mode("overwrite").save()


def read_csr(spark: SparkSession, path: str, partitions: int = 8, rows: tuple[int, int] | None = None) -> DataFrame:
    """(i, j, v); rows: first and last (not included), whose entries alone are read."""
    spark.dataSource.register(CsrSource)
    options = {"path": path, "partitions": str(partitions)} | ({"from": str(rows[0]), "to": str(rows[1])} if rows else {})
    return spark.read.format("csr").options(**options).load()
