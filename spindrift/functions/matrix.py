"""Sparse matrices as rows (i, j, v): canonical form, shape changes, tiles and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(a: DataFrame) -> DataFrame:
    """One row per place: values of the same place are added."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def drop_zeros(a: DataFrame) -> DataFrame:
    return a.where(F.col("v") != 0)


def cast_values(a: DataFrame, kind: str) -> DataFrame:
    return a.withColumn("v", F.col("v").cast(kind))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetric(a: DataFrame) -> DataFrame:
    """Of an undirected graph, one row per edge: both directions; a loop stays one row."""
    return canonical(a.unionByName(transpose(a).where("i <> j")))


def symmetrised(a: DataFrame) -> DataFrame:
    """The matrix plus its transpose."""
    return canonical(a.unionByName(transpose(a)))


def undirected(a: DataFrame) -> DataFrame:
    """One row per unordered pair, values added."""
    return canonical(a.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v"))


def from_one(ids: Column, base: Column) -> Column:
    """Zero-based ids where the smallest, `base`, is over 0."""
    return F.when(base > 0, ids - base).otherwise(ids)


def zero_based(a: DataFrame) -> DataFrame:
    base = a.agg(F.min(F.least("i", "j")).alias("_b"))
    return a.join(F.broadcast(base)).select(from_one(F.col("i"), F.col("_b")).alias("i"), from_one(F.col("j"), F.col("_b")).alias("j"), "v")


def with_tiles(a: DataFrame, size: int, row: str = "i", column: str = "j") -> DataFrame:
    """Add tile coordinates bi, bj and places in the tile ri, rj."""
    return a.withColumns({
        "bi": F.expr(f"{row} div {size}"), "bj": F.expr(f"{column} div {size}"),
        "ri": F.pmod(F.col(row), F.lit(size)), "rj": F.pmod(F.col(column), F.lit(size)),
    })


def structured_tiles(tiles: DataFrame, banded: bool = True) -> DataFrame:
    """Tiles of the first row, the first column and the diagonal; banded: its neighbours too."""
    near = F.abs(F.col("bi") - F.col("bj")) <= (1 if banded else 0)
    return tiles.where((F.col("bi") == 0) | (F.col("bj") == 0) | near)


def block_count(a: DataFrame, size: int, row: str = "i", column: str = "j") -> DataFrame:
    """`blocks`: tiles per side after trailing empty rows and columns are left out; 0 for a matrix without entries."""
    last = F.max(F.greatest(F.col(row), F.col(column)))
    return a.agg(F.coalesce(F.ceil((last + 1) / F.lit(size)), F.lit(0)).cast("long").alias("blocks"))


def relabel(a: DataFrame, mapping: DataFrame, n: int) -> DataFrame:
    """Rows and columns renamed by mapping (old, new), which must be a bijection on 0 to n - 1. An entry outside 0 to n - 1
    ends the job that reads the result."""
    wrong = [bijection_errors(m, n).first().asDict() for m in (mapping, mapping.select(F.col("new").alias("old"), F.col("old").alias("new")))]
    if any(any(w.values()) for w in wrong):
        raise ValueError(f"the mapping isn't a bijection: {wrong}")
    rows = mapping.select(F.col("old").alias("i"), F.col("new").alias("_i"))
    columns = mapping.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    refused = lambda c: F.raise_error(F.concat(F.lit(f"{c} isn't in 0 to {n - 1}: "), F.col(c).cast("string"))).cast("long")
    found = [F.coalesce(f"_{c}", refused(c)).alias(c) for c in "ij"]
    return a.join(rows, "i", "left").join(columns, "j", "left").select(*found, "v")


def bijection_errors(mapping: DataFrame, n: int) -> DataFrame:
    """One row: `missing`, `repeated` and `outside` names of a mapping (old, new) on 0 to n - 1; all 0 if it is one."""
    return mapping.agg(
        (F.lit(n) - F.countDistinct("new")).alias("missing"),
        (F.count("new") - F.countDistinct("new")).alias("repeated"),
        F.count_if((F.col("new") < 0) | (F.col("new") >= n)).alias("outside"),
    )


def induced(a: DataFrame, vertices: DataFrame) -> DataFrame:
    """Entries whose row and column are both in vertices (v)."""
    return a.join(vertices.select(F.col("v").alias("i")), "i", "left_semi").join(vertices.select(F.col("v").alias("j")), "j", "left_semi").select("i", "j", "v")


def degrees(a: DataFrame) -> DataFrame:
    """v, d: entries in v's row and column together; a loop counts twice."""
    ends = a.select(F.explode(F.array("i", "j")).alias("v"))
    return ends.groupBy("v").agg(F.count("*").alias("d"))


def row_entries(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count("*").alias("nnz"))


def row_summary(a: DataFrame, n: int) -> DataFrame:
    """One row: `nonzero_rows`, `zero_rows`."""
    return a.agg(F.countDistinct("i").alias("nonzero_rows"), (F.lit(n) - F.countDistinct("i")).alias("zero_rows"))


def used_columns(a: DataFrame) -> DataFrame:
    return a.select("j").distinct()


def keeps(pi: Column, pj: Column, width: int, block: bool = False, prune: bool = True) -> Column:
    """Whether an entry at these positions is near the diagonal (in the band or in a diagonal block) or, pruning, in
    one of the first `width` rows and columns."""
    near = F.floor(pi / width) == F.floor(pj / width) if block else F.abs(pi - pj) <= width
    return near | ((pi < width) | (pj < width)) if prune else near


def actual_width(a: DataFrame, width: int, row: str = "i", column: str = "j") -> DataFrame:
    """`width`: the smallest W, at least the given one, with every entry in the band of W or the first W rows or columns."""
    i, j = F.col(row), F.col(column)
    return a.agg(F.greatest(F.lit(width), F.coalesce(F.max(F.least(F.abs(i - j), i + 1, j + 1)), F.lit(0))).cast("long").alias("width"))
