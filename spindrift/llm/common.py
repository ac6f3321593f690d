"""What the corpus operators share: reading tables, shared storage, fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..storage import materialise, number_rows

__all__ = ["materialise"]

#: Fixed value: the class of white space.
WHITE_SPACE = r"[\x20\x09-\x0D]"
#: The symbols that the quality counts name.
SYMBOLS = r"[#*$%&|<>]"
#: The share of documents, in fifths, that learners may read labels of: crc32(doc_id) mod 5 is not 0.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(text, F.lit(""))


def without_white_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE_SPACE}+", "")


def words(text: Column) -> Column:
    """The list of `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.filter(F.split(whole(text), f"{WHITE_SPACE}+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True where no label may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def with_columns(df: DataFrame, found: Column, *names: str) -> DataFrame:
    """df with the fields `names` of the struct `found`; columns of df with such a name are replaced. Whatever df's columns
    are called, none clashes: they are in a struct of their own on the way."""
    own = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    both = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own") if own else F.lit(0).alias("own"), found.alias("found"))
    return both.select(*[F.col("own")[c].alias(c) for c in own], *[F.col("found")[n].alias(n) for n in names])


def with_ids(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows as `id` long and `text`, and, where ids aren't the keys themselves, the key of each id.

    Distinct whole numbers are their own ids. Where keys are null, repeated or of another type, rows are numbered in the
    order of key (nulls last) and text, and written once, so that each keeps its number.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    if isinstance(rows.schema["key"].dataType, IntegralType) and rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL").isEmpty():
        return rows.select(F.col("key").cast("long").alias("id"), "text"), None
    rows = number_rows(rows, F.asc_nulls_last("key"), "text", name="id")
    return rows.select("id", "text"), rows.select("id", "key")
