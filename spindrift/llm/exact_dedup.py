"""Exact duplicates by sorting content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table, whole, without_white_space

#: Bytes of a text's head that the range partitioner's splitters carry; the digest orders what shares a head.
HEAD = 48
#: Rows that the search for texts with very many copies samples, for each shuffle partition.
SAMPLED = 64


def _hot_digests(rows: DataFrame, digest: Column, n_rows: int, parts: int) -> DataFrame:
    """Digests of texts that fill about half a partition or more, by a sample: 2 * parts of them at most.

    Only the spread of work hangs on the sample, never a result.
    """
    share = min(1.0, SAMPLED * parts / max(n_rows, 1))
    sampled = (rows.sample(share, seed=7) if share < 1 else rows).select(digest.alias("digest"))
    least = max(2.0, n_rows * share / parts / 2)
    return sampled.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("digest", F.lit(True).alias("hot"))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of df: key, `keep_id`, `group_size` long, `kept` boolean, `text_sha256` string; with `carry` also
    `row`, a struct of all columns of df.

    Texts are equal when their normalised bytes are (white space deleted; null counts as empty; very long ones are
    compared whole). Rows are range partitioned by normalised content at sampled splitters and sorted outside memory,
    which places equal texts side by side; neighbours are compared in full. Of a group the row with the longest original
    text stays, in code points, then the smallest key, nulls last; with repeated keys, `kept` is true for one row of each
    group. An empty table gives an empty one.

    A text with very many copies is dealt over several sub-ranges of the same content, each reduced to its best
    row; their bests, a row per sub-range, are reduced again. So no group lands in one task whole.
    """
    spark, parts = df.sparkSession, partitions(df.sparkSession)
    own = df.columns if carry else dict.fromkeys([key, text])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    body = whole(F.col("row")[text])
    norm = without_white_space(body)
    # a text is normalised once before the shuffle, and again after it only where its row is carried, which has it already
    made = rows.withColumn("norm", norm).select(
        "*", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), F.substring("norm", 1, HEAD).alias("head"),
        F.col("row")[key].alias("key"), F.char_length(body).alias("points"),
    )
    hot = F.broadcast(_hot_digests(rows, F.sha2(norm.cast("binary"), 256), df.count(), parts))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "points"), F.lit(2 * parts))).otherwise(F.lit(0))
    ranged = (
        made.join(hot, "digest", "left")
        .select("key", "points", "digest", "hot", "head", spread.alias("spread"), "row" if carry else "norm")
        .repartitionByRange("head", "digest", "spread")
    )
    ranged = ranged.withColumn("norm", norm) if carry else ranged
    same = Window.partitionBy("head", "digest", "spread", "norm")
    best = same.orderBy(F.desc("points"), F.asc_nulls_last("key"))
    # the range partitioning above already serves these windows: no second exchange
    local = ranged.select(
        "key", "digest", "hot", "points", *(["row"] if carry else []),
        F.row_number().over(best).alias("rank"),
        F.first("key").over(best).alias("best"),
        F.first("points").over(best).alias("best_points"),
        F.count("*").over(same).alias("n"),
    )
    local = materialise(local, "exact-runs")
    # of hot texts only: one row per sub-range
    heads = local.where(F.col("hot") & (F.col("rank") == 1))
    merged = heads.groupBy("digest").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.isnull("key").alias("z"), F.col("key").alias("k"))).alias("top"),
        F.sum("n").alias("total"),
    )
    joined = local.join(F.broadcast(merged), "digest", "left")
    keep = F.when(F.col("top").isNotNull(), F.col("top.k")).otherwise(F.col("best"))
    points = F.when(F.col("top").isNotNull(), -F.col("top.p")).otherwise(F.col("best_points"))
    return joined.select(
        F.col("key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        ((F.col("rank") == 1) & F.col("key").eqNullSafe(keep) & (F.col("points") == points)).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
