"""Sharding of records by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table, whole

SEED = 17
#: Hexadecimal digits of an md5 that make a share of one: 52 bits, which a double holds exactly.
DIGITS = 13


def _as_text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def _digits(text: Column) -> Column:
    """The first digits of a text's md5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _strength(key: Column, shard: int, weight: float, seed: int) -> Column:
    """Of one shard for one key: weight / -ln(u), with u in (0, 1) from the md5 of the pair."""
    u = (_digits(F.concat(_as_text(key), F.lit(f":{shard}:{seed}"))).cast("double") + 0.5) * F.lit(2.0**-52)
    return F.lit(float(weight)) / -F.log(u)


def _strongest(key: Column, weights: Sequence[float], seed: int) -> Column:
    """Struct of the strength `s` and the number `j` of the shard that a key goes to; of equal ones the last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scored = [F.struct(_strength(key, j, w, seed).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights)]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard, 0 to len(weights) - 1, that a key goes to.

    Each shard gets a share of the keys in proportion to its weight (over 0). A shard that is appended takes keys
    only into itself, about its share of them; no other key moves. A null key is one key like any other.
    """
    return _strongest(key, weights, seed)["j"]


def shard_records(
    df: DataFrame, key: str, weights: Sequence[float], ties: Sequence[str] = (), grow_by: float | None = None, seed: int = SEED
) -> DataFrame:
    """Add `shard` int, `slot` long (gapless from 0 within a shard) and, with grow_by, `grown_shard` int: the shard
    if one more shard of that weight were appended. Columns that df has by these names are replaced.

    Slots follow a hash of the key and `ties`, then these themselves, nulls first; only rows equal in all of them may
    swap slots. Rows are numbered within (shard, slice of the hash's range), so that neither a shard nor a key that very
    many rows share is one task, as long as `ties` tell its rows apart; a slice's first slot comes from the counts of the
    slices before it. Texts play no part, so empty and very long ones are rows like any other; null keys are one key;
    repeated rows get slots of their own. An empty table gives an empty table.
    """
    slices = 4 * partitions(df.sparkSession)
    made = {"shard", "slot", "grown_shard"}
    own = [c for c in df.columns if c.lower() not in made]
    h = _digits(F.concat_ws(":", *[_as_text(F.col(f"`{c}`")) for c in (key, *ties)], F.lit(seed)))
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), h.alias("h"), _strongest(F.col(f"`{key}`"), weights, seed).alias("best"))
    grown = F.lit(None).cast("int")
    if grow_by is not None:
        more = _strength(F.col("row")[key], len(weights), grow_by, seed)
        grown = F.when(more >= F.col("best.s"), F.lit(len(weights))).otherwise(F.col("best.j"))
    placed = placed.select("row", "h", F.col("best.j").alias("shard"), grown.alias("grown"), F.floor(F.col("h") / (2.0**52 / slices)).alias("slice"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("shard", "slice").orderBy("h", *[F.col("row")[c] for c in (key, *ties)])
    numbered = placed.withColumn("rank", F.row_number().over(within)).join(first, ["shard", "slice"])
    slot = (F.col("first") + F.col("rank") - 1).alias("slot")
    return numbered.select(*[F.col("row")[c].alias(c) for c in own], "shard", slot, *([F.col("grown").alias("grown_shard")] if grow_by is not None else []))


def op7_sharding(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards of equal weight by doc_id: law `key`."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(whole(F.col("text")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_records(docs, "doc_id", [1.0] * shards, ties=("text_crc32", "size"), grow_by=1.0)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL: a byte at a time, its table's entry as the sum of those of its bits."""
    rows = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        rows.append(c)
    low = "xor(s, b)"
    entry = f"({low} & 1) * {rows[0]}"
    for bit in range(1, 8):
        entry = f"xor({entry}, (({low} >> {bit}) & 1) * {rows[bit]})"
    step = f"xor(s >> 8, {entry})"
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    octets = f"list_transform({pairs}, lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda s, b: {step}), 4294967295)"


def _share_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32_sql("coalesce(text, '')")}::BIGINT AS text_crc32 FROM documents),
u AS (SELECT doc_id, j, {_share_sql(f"doc_id || ':' || j || ':{SEED}'")} AS u FROM documents, range(25) t(j)),
s AS (
  SELECT doc_id, arg_max(j, u) FILTER (j < 24) AS shard, arg_max(j, u) AS grown_shard FROM u GROUP BY doc_id),
h AS (SELECT d.*, s.shard, s.grown_shard, {_share_sql(f"concat(d.doc_id, ':', text_crc32, ':', size, ':{SEED}')")} AS h FROM d JOIN s USING (doc_id))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM h
"""
