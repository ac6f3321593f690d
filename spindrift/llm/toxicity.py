"""Toxicity: class-conditional Kneser-Ney models over words with shared backoff."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, with_columns
from .word_models import WordModels, contexts

#: Labelled rows of each class to learn from, about: the bound of the sample.
TRAIN_ROWS = 6_000
FEATURES = 6


@dataclass
class Model:
    """The classes' models of words, and the plane from a text's differences to the log-odds: weights, and last the offset,
    for features less `mean`, over `scale`."""

    words: WordModels
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0] + [0.0] * FEATURES))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))

    def score(self, text: str | None) -> float:
        z = ((np.array(self.words.features(text)) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """By Newton's method, with a slight pull to 0."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w, pull = np.zeros(a.shape[1]), np.full(a.shape[1], 1e-2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
            w = w + np.clip(np.linalg.solve(h, a.T @ (y - p) - pull * w), -5, 5)
        self.weights = w


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from about `rows` documents of each class, chosen among the labels by a hash of the key; the labels chosen,
    2 * rows about, are sent to the documents, whose texts stay where they are.

    Three quarters give the counts of words, summed by Spark; the differences of the others, which no count has seen, give
    the plane to the log-odds. Without rows of both classes nothing is calibrated, and without any every score is a half.
    """
    labels = labels.where(F.col(toxic).isin(0, 1)).select(F.col(key), F.xxhash64(key, F.lit("kn")).alias("_h"), F.col(toxic).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    limit = F.lit(0)
    for k, m in n.items():
        limit = F.when(F.col("toxic") == k, F.lit(int(min(1.0, rows / m) * 1_000_000))).otherwise(limit)
    chosen = labels.where(F.pmod(F.shiftright("_h", 8), F.lit(1_000_000)) < limit)
    chosen = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    first = F.pmod("_h", F.lit(4)) != 0

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("toxic"):
                u, w = contexts(list(part["text"]))
                yield pd.DataFrame({"k": k, "u": u, "w": w})

    found = chosen.where(first).select("text", "toxic").mapInPandas(pairs, "k int, u long, w long").distinct()
    model = Model(WordModels.fit(found.groupBy("k", "w").agg(F.count("*").alias("n")).toArrow().to_pandas()))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [shared.value.features(t) for t in batch["text"]]})

    shared = docs.sparkSession.sparkContext.broadcast(model.words)
    scored = chosen.where(~first).select("toxic", "text").mapInPandas(features, "toxic int, x array<double>").toPandas()
    if scored["toxic"].nunique() == 2:
        model.calibrate(np.array(scored["x"].tolist(), float), scored["toxic"].to_numpy(float))
    return model


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` double, 0 to 1: the probability that a text is toxic, from the length-normalised difference of its
    two log-likelihoods and the largest differences of its words. Null and empty texts, and those without words (runs of
    letters and digits), differ by nothing and get the probability at 0. Very long texts count whole, in pieces. Equal
    texts get equal scores, so ties stay ties; repeated rows stay, and so do rows of null key, of which no label is
    learned; an empty table stays empty; a column `score` that df has is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return with_columns(df, F.struct(score(F.col(text)).alias("score")), "score")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; of a null doc_id `held_out` is null."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = fit_toxicity(docs, known)
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
