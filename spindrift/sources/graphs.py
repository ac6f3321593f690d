"""Graphs and dense matrices made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import deal, materialise, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def dealt(spark: SparkSession, sf_dir: str, name: str, joins: bool = False) -> DataFrame:
    """The table; tasks are as many as its rows need from now on, and broadcasts small where many joins follow."""
    deal(spark, rows_of(spark, sf_dir, name), joins)
    return table(spark, sf_dir, name)


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Parts and, after them, suppliers; values count line items."""
    parts, suppliers = rows_of(spark, sf_dir, "part"), rows_of(spark, sf_dir, "supplier")
    items = dealt(spark, sf_dir, "lineitem")
    a = items.groupBy(F.col("l_partkey").alias("i"), (F.col("l_suppkey") + parts).alias("j")).agg(F.count("*").cast("double").alias("v"))
    return a, parts + suppliers


def customer_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Customers and, after them, parts; values count line items of the customer's orders."""
    customers, parts = rows_of(spark, sf_dir, "customer"), rows_of(spark, sf_dir, "part")
    pairs = table(spark, sf_dir, "orders").join(dealt(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a = pairs.groupBy(F.col("o_custkey").alias("i"), (F.col("l_partkey") + customers).alias("j")).agg(F.count("*").cast("double").alias("v"))
    return a, customers + parts


def nation_trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Directed, from the customer's nation to the supplier's; values count line items."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("i"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = dealt(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = items.join(o, items["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("i", "j").agg(F.count("*").cast("double").alias("v")), rows_of(spark, sf_dir, "nation")


def user_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Directed, from each user to the one of the next event of the type; values count steps. Loops occur."""
    events = dealt(spark, sf_dir, "events", joins=True).select("user_id", "event_type", "ts", "event_id")
    # a type may hold any share of the events, so places come from range partitions, not from a window over the type
    placed = materialise(number_rows(events, "event_type", "ts", "event_id"), "placed")
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("event_type").alias("_type"), F.col("user_id").alias("j"))
    steps = placed.join(after, "pos").where(F.col("event_type").eqNullSafe(F.col("_type")) & F.col("j").isNotNull())
    steps = steps.select(F.col("user_id").alias("i"), "j")
    n = events.agg(F.max("user_id") + 1).first()[0]
    return steps.groupBy("i", "j").agg(F.count("*").cast("double").alias("v")), n


def trade_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Regions, nations, customers and orders, each linked to the one it belongs to: a forest of one tree a region."""
    r, n, c, o = (rows_of(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    deal(spark, r + n + c + o, joins=True)
    one = F.lit(1.0).alias("v")
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("i"), (F.col("n_nationkey") + r).cast("long").alias("j"), one)
    customers = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + r).cast("long").alias("i"), (F.col("c_custkey") + r + n).alias("j"), one)
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") + r + n).alias("i"), (F.col("o_orderkey") + r + n + c).alias("j"), one)
    return nations.unionByName(customers).unionByName(orders), r + n + c + o


def dense(spark: SparkSession, n: int, features: int) -> DataFrame:
    """(7 v + 3 f) mod 11, whole numbers."""
    x = ((F.col("v") * 7 + F.col("f") * 3) % 11).cast("double").alias("x")
    return spark.range(n).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("f")).select("v", "f", x)


def dense_wide(spark: SparkSession, n: int, features: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"), *[((F.col("id") * 7 + f * 3) % 11).cast("double").alias(f"f{f}") for f in range(features)])


def dense_embeddings(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, int]:
    """v, x: the embedding at place v mod their number, as an array; and the number of features."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    count, features = rows_of(spark, sf_dir, "embeddings"), e.select(F.size("x")).first()[0]
    return spark.range(n).select(F.col("id").alias("v"), (F.col("id") % count).alias("vec_id")).join(e, "vec_id").select("v", "x"), features
