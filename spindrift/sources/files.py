"""Reading and writing matrices and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import canonical, transpose
from ..operators.peel import Levels
from ..storage import materialise


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Coordinate text: (i, j, v from 0, rows, columns). A pattern has ones; symmetric and skew-symmetric files hold one
    half, and the other is added. The header and the size line alone are read by the driver. A file of more or fewer
    entries than its size line says is refused."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("%%")).first()
    kind = head[0].lower().split() if head else ["%%matrixmarket", "matrix", "coordinate", "real", "general"]
    if "coordinate" not in kind:
        raise ValueError("only coordinate files hold sparse matrices")
    if {"complex", "hermitian"} & set(kind):
        raise ValueError("values must be real numbers")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    first = body.first()["p"]
    size = [int(x) for x in first[:2]]
    pattern = "pattern" in kind
    entries = body.count() - 1
    if entries != int(first[2]):
        raise ValueError(f"{path} has {entries} entries and says {first[2]}")
    # an entry of whole numbers may equal the size line: of the equal lines one alone is left out
    same = F.col("p") == F.array(*map(F.lit, first))
    equal = body.where(same).groupBy("p").agg(F.count("*").alias("c")).where("c > 1")
    again = equal.select("p", F.explode(F.sequence(F.lit(2), F.col("c").cast("int")))).select("p")
    rest = body.where(~same).unionByName(again) if not pattern else body.where(F.size("p") == 2)
    value = F.lit(1.0) if pattern else F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0))
    a = rest.select((F.get("p", F.lit(0)).cast("long") - 1).alias("i"), (F.get("p", F.lit(1)).cast("long") - 1).alias("j"), value.alias("v"))
    if "symmetric" in kind:
        a = a.unionByName(transpose(a).where("i <> j"))
    elif "skew-symmetric" in kind:
        a = a.unionByName(transpose(a).where("i <> j").withColumn("v", -F.col("v")))
    return canonical(a), size[0], size[1]


def write_matrix_market(a: DataFrame, rows: int, columns: int, path: str) -> None:
    """(i, j, v from 0) as general coordinate text. The format is one file that starts with its header, so one task writes."""
    entries = canonical(a).select(F.lit(2).alias("k"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    spark, n = a.sparkSession, entries.count()
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{rows} {columns} {n}")], "k int, value string")
    head.unionByName(entries).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def write_levels(levels: Levels, path: str) -> None:
    """Three Parquet tables; entries and permutations are partitioned by level, and a level's width is in `meta`."""
    levels.edges.write.mode("overwrite").partitionBy("level").parquet(f"{path}/edges")
    levels.perm.write.mode("overwrite").partitionBy("level").parquet(f"{path}/perm")
    levels.meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_levels(spark: SparkSession, path: str, level: int | None = None) -> Levels:
    """All levels or one; only its files are read. A value that a file lacks is 1."""
    meta = spark.read.parquet(f"{path}/meta")
    edges, perm = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/perm")
    if level is not None:
        edges, perm, meta = (t.where(F.col("level") == level) for t in (edges, perm, meta))
    value = F.coalesce("v", F.lit(1.0)) if "v" in edges.columns else F.lit(1.0)
    return Levels(edges.withColumn("v", value), perm, meta, meta.agg(F.max("n")).first()[0])


def level_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/meta").agg(F.coalesce(F.max("level") + 1, F.lit(0))).first()[0]


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles in folders by row of tiles, so that reading one opens one folder."""
    tiles.write.mode("overwrite").partitionBy("bi").parquet(path)


#: Entries that a folder of catalogued tiles should hold.
FOLDER_ENTRIES = 500_000


def write_tile_catalogue(tiles: DataFrame, path: str, entries: int = FOLDER_ENTRIES) -> None:
    """Tiles sorted by place, in folders of neighbouring ones that hold about so many entries, and beside them a small table
    of each tile's place, folder and number of entries. A tile with many entries may lie in several folders. Folders are
    written by one task each, so files are as many as folders, however many rows of tiles or tasks there are."""
    tiles = materialise(tiles, "tiles")
    parts = max(1, -(-tiles.count() // entries))
    placed = tiles.repartitionByRange(parts, "bi", "bj", "i", "j").withColumn("folder", F.spark_partition_id())
    placed.sortWithinPartitions("folder", "bi", "bj").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/tiles")
    written = tiles.sparkSession.read.parquet(f"{path}/tiles")
    counts = written.groupBy("bi", "bj", "folder").agg(F.count("*").alias("_own")).groupBy("bi", "bj").agg(F.sum("_own").alias("entries"), F.collect_list("folder").alias("folders"))
    counts.write.mode("overwrite").parquet(f"{path}/catalogue")


def read_catalogued(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """Entries, bi and bj of the tiles whose row of the catalogue (bi, bj, entries, folders) meets the condition `wanted`. The
    folders to open are known at run time only, when the catalogue has been read; others are pruned then."""
    chosen = spark.read.parquet(f"{path}/catalogue").where(wanted).select("bi", "bj", F.explode("folders").alias("folder"))
    return spark.read.parquet(f"{path}/tiles").join(chosen, ["folder", "bi", "bj"]).select("i", "j", "v", "bi", "bj")


def read_tile(spark: SparkSession, path: str, bi: int, bj: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("bi") == bi) & (F.col("bj") == bj))


def pattern_histogram(a: DataFrame, size: int) -> DataFrame:
    """y, x, entries: counts on a grid of cells of size x size places, what a picture of the pattern shows."""
    return a.groupBy(F.expr(f"i div {size}").alias("y"), F.expr(f"j div {size}").alias("x")).agg(F.count("*").alias("entries"))
