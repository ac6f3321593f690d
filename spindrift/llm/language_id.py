"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, with_columns
from .letters import letter_pieces

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows to learn from, about (chosen by a hash of the row): the bound of the sample.
TRAIN_ROWS = 20_000
SMOOTHING = 0.1
#: Texts that are scored together.
BLOCK = 64
#: Odd multipliers of the n-gram hash.
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs; None for a text without a letter."""
    counts = None
    overlap = max(ORDERS) - 1
    for nth, codes in enumerate(letter_pieces(text, overlap)):
        if not (codes != 32).any():
            continue
        counts = np.zeros(BUCKETS, np.int64) if counts is None else counts
        wide = codes.astype(np.uint64)
        for n in ORDERS:
            # grams inside the overlap were counted with the piece before
            own = wide[overlap - n + 1 :] if nth else wide
            if len(own) < n:
                continue
            h = np.zeros(len(own) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ own[k : len(own) - n + 1 + k]) * _MIX[k]
            h = (h ^ np.uint64(n)) * _MIX[0]
            counts += np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return counts


def fit_language_model(labelled: DataFrame, text: str, lang: str, row_key: str, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities (prior in the last row), from about `rows` labelled rows.

    Executors count n-grams; languages x buckets sums come to the driver. No labelled row: no languages.
    """
    n = labelled.count()
    share = min(1.0, rows / max(n, 1))
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64(row_key, F.lit("nb")), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch[text], batch[lang], strict=True):
                if (got := _gram_counts(t)) is not None:
                    into = held.setdefault(k, np.zeros(BUCKETS + 1, np.int64))
                    into[:-1] += got
                    into[-1] += 1
        for k, c in held.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": k, "bucket": at, "n": c[at]})

    grams = labelled.select(text, lang).mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(grams["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.searchsorted(langs, grams["lang"]) if len(langs) else [], grams["bucket"]] = grams["n"]
    logs = np.log(counts[:, :-1] + SMOOTHING) - np.log((counts[:, :-1] + SMOOTHING).sum(axis=1, keepdims=True)) if langs else np.zeros((0, BUCKETS))
    prior = np.log(counts[:, -1:] / counts[:, -1:].sum()) if langs else np.zeros((0, 1))
    return langs, np.hstack([logs, prior]).T.astype(np.float32).copy()


def detect_language(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Add `lang_pred` string and `score` double, the posterior probability of that language.

    A null or empty text, one without a letter, or any text where no language was learned, is `und` with score 0. Of
    languages that are as likely the first by name is taken. A very long text counts whole, in pieces. Equal texts get
    equal results, repeated rows stay, an empty table stays empty; columns that df has by these names are replaced.
    """
    langs = model[0]
    shared = df.sparkSession.sparkContext.broadcast(model[1])

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def detect(texts: pd.Series) -> pd.DataFrame:
        logs, names, scores = shared.value, np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for low in range(0, len(texts) if langs else 0, BLOCK):
            found = [(low + k, c) for k, t in enumerate(texts.iloc[low : low + BLOCK]) if (c := _gram_counts(t)) is not None]
            if not found:
                continue
            # the block's counts as one sparse matrix, a row a text
            at = [np.flatnonzero(c) for _, c in found]
            weighted = logs[np.concatenate(at)] * np.concatenate([c[x] for (_, c), x in zip(found, at, strict=True)])[:, None].astype(np.float64)
            total = np.add.reduceat(weighted, np.cumsum([0] + [len(x) for x in at[:-1]])) + logs[-1]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            rows = [k for k, _ in found]
            names[rows] = np.array(langs, object)[p.argmax(axis=1)]
            scores[rows] = p.max(axis=1) / p.sum(axis=1)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return with_columns(df, detect(F.col(text)), "lang_pred", "score")


def learnable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(key)) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def with_language(docs: DataFrame) -> DataFrame:
    """The documents with `lang_pred` and `score`, learned from the rows outside the held-out fold."""
    return detect_language(docs, fit_language_model(learnable(docs), "text", "lang", "doc_id"))


def accepted(lang_pred: Column, score: Column, least: float = 0.5) -> Column:
    """What a filter by language keeps: a language was found, and it is likelier than all others together."""
    return (lang_pred != UNKNOWN) & (score >= least)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents; of a null doc_id `held_out` is null, and nothing is learned from its row."""
    docs = table(spark, sf_dir, "documents")
    return with_language(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
