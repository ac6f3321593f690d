"""A corpus from raw documents: language, exact and near duplicates, a mix of sources, packed sequences.

Documents have doc_id, text, lang, source, n_chars and whatever columns else; all but the last stage return them. A null
or empty text has no letter, so the first stage rejects it. Repeated rows are equal texts, of which the second keeps one.
Ids may be null or shared by different texts: each stage decides on rows, which it carries whole in one column, so that
no name of theirs clashes with its own. Of rows that tie in all that a stage orders by, any one is taken. Very long texts
are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from spindrift.llm.common import materialise, table, words
from spindrift.llm.exact_dedup import exact_groups
from spindrift.llm.jaccard_join import similar_components
from spindrift.llm.language_id import accepted, detect_language, fit_language_model, learnable
from spindrift.llm.mixing import mix
from spindrift.llm.packing import pack


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _identified(docs: DataFrame) -> DataFrame:
    """`id`, a long of its own for each row, `doc_id` and `row`: doc_id itself where that is a whole number of its own for
    each, and else a number that is written once, so that it stays the row's."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
            return docs.select(F.col("doc_id").cast("long").alias("id"), "doc_id", _row(docs))
    return materialise(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", _row(docs)), "pipeline-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found, likelier than all others together."""
    model = fit_language_model(learnable(docs), "text", "lang", "doc_id")
    found = detect_language(docs.select(_row(docs), "text"), model)
    return found.where(accepted(F.col("lang_pred"), F.col("score"))).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_groups(docs, carry=True).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links of 0.8 on five-word shingles connect."""
    rows = _identified(docs)
    groups = similar_components(rows.select("id", F.col("row.text").alias("text")), "id", words=5, share=80).select("id", "component_id")
    by_id = F.struct(F.isnull("doc_id").alias("z"), F.col("doc_id").alias("k"), F.col("id").alias("i"))
    best = groups.join(rows.select("id", "doc_id"), "id").groupBy("component_id").agg(F.min(by_id).alias("best"))
    return rows.join(best.select(F.col("best.i").alias("id")), "id", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; one taken in part, the last of its source, ends there."""
    # drawn by id and text, so that different texts of one id, or of none, are drawn apart
    draw = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    taken = mix(docs.select(draw.alias("draw"), "text", "source", _row(docs)), "draw", also=("row",)).where("taken > 0")
    rows = taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size")).cast("int")
    cut, text = left < F.col("size"), F.col("row.text")
    new = {"text": F.when(cut, F.array_join(F.slice(words(text), 1, left), " ")).otherwise(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut, F.char_length(new["text"])).otherwise(F.col("row.n_chars")).cast(kind)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 1024 tokens."""
    # as text on the way: pandas would hold whole numbers among nulls as floats
    kind = docs.schema["doc_id"].dataType
    return pack(docs.select(F.col("doc_id").cast("string"), "text")).withColumn("doc_id", F.col("doc_id").cast(kind))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: A learned model, a tokenizer and a hash decide; SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
