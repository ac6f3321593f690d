"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own, if all runs on this machine: other hosts couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of input for each task of a shuffle, and bytes of a file or a shuffle, compressed, that a task should take at most.
TASK_ROWS, TASK_BYTES = 250_000, {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
#: Bytes of a table, as planned, up to which a join may send it to the driver and all tasks, where a query has many joins.
BROADCAST_BYTES = 256 << 10
#: Bytes of rows that Spark sends to a Python worker at once, where texts or sets go there.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PARTITIONS, _BROADCAST, _DEALT = "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spindrift.dealt"


def _bytes(text: str) -> int:
    number = text.strip().lower().rstrip("b")
    power = "kmgtp".find(number[-1]) + 1
    return int(number[:-1] if power else number) << 10 * power


def deal(spark: SparkSession, rows: int, joins: bool = False) -> None:
    """Let what is planned from now on run in as many tasks as a table of so many rows needs, so that what a task holds
    doesn't grow with the input: more partitions of shuffles, of which adaptive execution joins small ones only, and
    smaller pieces of files. joins: of a table larger than one task's, only small tables are broadcast, since those of some
    hundred joins add up on the driver. Where the session's own settings do, they hold, also again after a larger table."""
    found = {k: spark.conf.get(k) for k in (_PARTITIONS, _BROADCAST, *TASK_BYTES)}
    before = json.loads(spark.conf.get(_DEALT, "{}"))
    # what isn't as this left it, somebody else has set since
    own = {k: before[k][0] if k in before and before[k][1] == v else v for k, v in found.items()}
    parts = max(int(own[_PARTITIONS]), -(-rows // TASK_ROWS))
    many = parts > int(own[_PARTITIONS])
    wanted = {_PARTITIONS: str(parts)} | {k: f"{min(most, _bytes(own[k]))}b" if many else own[k] for k, most in TASK_BYTES.items()}
    wanted[_BROADCAST] = f"{BROADCAST_BYTES}b" if joins and rows > TASK_ROWS and _bytes(own[_BROADCAST]) > BROADCAST_BYTES else own[_BROADCAST]
    for k, v in wanted.items():
        if v != found[k]:
            spark.conf.set(k, v)
    spark.conf.set(_DEALT, json.dumps({k: [own[k], v] for k, v in wanted.items()}))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends rows to Python in batches of BATCH_BYTES, or of less if the session says so: a batch of 10,000
    texts, however long, is held several times over, by the executor outside its heap and by the worker."""
    own = spark.conf.get(_BATCH, None)
    if own is None or _bytes(own) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, own)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df and read it back: ends its lineage and gives the optimiser true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way, by name; what it doesn't read again it empties, so that not all of them
    take disk until the end."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def empty(self, *names: str) -> None:
        for name in names:
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{name}")


class Rounds:
    """The tables that a loop writes round by round: each takes the place of the one before the last, so that a loop of any
    length leaves two. A round may read the round before it, none earlier."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.nth = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.nth = f"{self.path}/{self.nth % 2}", self.nth + 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Add each row's place, 0 to n - 1, in a total order, without one task for all rows: rows are range partitioned and
    sorted once; the place in the partition is moved by the counts of the partitions before, a row for each partition."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the low bits of this id are the row's place in its partition
    parts = parts.withColumn("_part", F.spark_partition_id()).withColumn("_rank", F.monotonically_increasing_id().bitwiseAND(2**33 - 1))
    parts = materialise(parts, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return parts.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_rank")).drop("_part", "_rank", "_first")


def sums_before(df: DataFrame, columns: list[str], *order) -> DataFrame:
    """Add `before_` and each column's name: its sum over the rows before, in a total order, 0 for the first. Rows are range
    partitioned and summed within partitions; what the partitions before hold comes from a row for each partition."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = materialise(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "summed")
    held = parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_first_{c}") for c in columns])
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    both = parts.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_within_{c}") for c in columns]).join(F.broadcast(held), "_part")
    return both.select(*df.columns, *[(F.col(f"_first_{c}") + F.col(f"_within_{c}")).alias(f"before_{c}") for c in columns])
