"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import number_rows, sums_before
from .common import SYMBOLS, materialise, partitions, table, whole, without_white_space, words

#: No document is taken more often than this.
MOST_EPOCHS = 3
SEED = "mix-1"
#: Sources, of under a hundred bytes each, up to which their targets are sent to the documents; beyond, the two are joined.
SENT = 1 << 16


def quality_weight(text: Column) -> Column:
    """0.05 to 1: one less the share of symbols among a text's characters without white space, five-fold."""
    solid = without_white_space(whole(text))
    chars = F.char_length(solid)
    marks = chars - F.char_length(F.regexp_replace(solid, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), (1 + chars - 5 * marks).cast("double") / (1 + chars))


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from 13 hexadecimal digits of an md5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("long").cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """A row per source: source, `source_size` long, `target` double.

    Sources, by code point and null last, weigh `weights`, repeating; together they get the sum of all sizes. No
    target passes `most` times its source's size; the excess goes to the others by weight until none is above.
    In closed form: with sources by size over weight, the level is the first one that the next source isn't below.
    Sources may be many, such as sites: they are numbered and summed in range partitions, and the driver gets the two totals
    and the level.
    """
    per = number_rows(sizes.groupBy(source).agg(F.sum(size).alias("source_size")), F.asc_nulls_last(source), name="_nth")
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int")))
    per = per.withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("_w"))
    per = materialise(sums_before(per, ["source_size", "_w"], "_ratio", "_nth"), "mix-sources")
    total, weight = per.agg(F.sum("source_size"), F.sum("_w")).first()
    per = per.withColumn("_level", (F.lit(total) - most * F.col("before_source_size")) / (F.lit(weight) - F.col("before__w")))
    first = per.where("_ratio >= _level").agg(F.min(F.struct("_ratio", "_nth", "_level"))["_level"]).first()[0]
    level = F.lit(first).cast("double")
    return per.select(source, "source_size", F.least(F.col("source_size").cast("double") * most, level * F.col("_w")).alias("target"), "_nth")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), seed: str = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: key, source, `size`, `source_size`, `target`, `taken` long, `epochs` long, and the columns `also`.

    Size counts words, of very long texts too; a null or empty text has none and is never taken. Documents with equal keys
    go by size, null keys are one key; only rows equal in both may swap what is taken. An empty table gives an empty one. A source's target is spent on complete
    epochs of all its documents first; the rest on documents in the order of their keys -ln(u) / w, smallest first,
    u from a hash of the document's key and w from the text's share of symbols. The last document is taken in
    part, up to the target. The same rows give the same mix each time.

    Running sums are taken within (source, slice of the key's range); what the slices before hold comes from their
    sums, so that one source, however large, is spread over many tasks.
    """
    spark = df.sparkSession
    key_of = -F.log(uniform(F.col(key), seed)) / quality_weight(F.col(text))
    slices = 16 * partitions(spark)
    base = materialise(df.select(key, source, *also, F.size(words(F.col(text))).cast("long").alias("size"), key_of.alias("_order")), "mix-sizes")
    targets = materialise(source_targets(base, source, weights=weights), "mix-targets")
    targets = F.broadcast(targets) if targets.count() <= SENT else targets
    joined = base.join(targets, base[source].eqNullSafe(targets[source])).drop(targets[source])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("epochs", epochs).withColumn("_rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    # about even for weights from 0.05 to 1
    even = 1 - (F.exp(-F.col("_order")) + F.exp(-F.col("_order") / 20)) / 2
    joined = joined.withColumn("_slice", F.floor(even * slices))
    within = Window.partitionBy("_nth", "_slice").orderBy("_order", F.asc_nulls_last(key), "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_nth").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = joined.groupBy("_nth", "_slice").agg(F.sum("size").alias("_held"))
    sums = sums.select("_nth", "_slice", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    placed = joined.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["_nth", "_slice"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_within")))
    return placed.select(key, source, "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "epochs", *also)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS solid FROM documents),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(solid) AS chars, length(solid) - length(translate(solid, '#*$%&|<>', '')) AS marks FROM t),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.05, (1 + chars - 5 * marks)::DOUBLE / (1 + chars)) AS o FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, (nth % 3 + 1)::DOUBLE AS wt, 3 * source_size / (nth % 3 + 1)::DOUBLE AS ratio FROM n),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce((sum(source_size) OVER b)::BIGINT, 0))::DOUBLE
            / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lev
  FROM w WINDOW b AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (SELECT lev FROM l WHERE ratio >= lev ORDER BY ratio, nth LIMIT 1) AS lvl FROM l),
a AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, lvl * wt) AS target FROM g),
j AS (
  SELECT k.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size)::BIGINT ELSE 0 END AS e
  FROM k JOIN a ON k.source IS NOT DISTINCT FROM a.source),
r AS (SELECT *, coalesce((sum(size) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS c FROM j)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, floor(target)::BIGINT - e * source_size - c)))::BIGINT AS taken FROM r
"""
