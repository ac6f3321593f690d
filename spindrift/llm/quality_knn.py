"""Quality classifier: votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, with_columns

#: Labelled rows that are neighbours to choose from, about: the bound of the sample.
TRAIN_ROWS = 4_000
#: Hashed terms: words, n-grams of a text's outline, and bins of its proportions.
WORDS, SHAPES, BINS = 2048, 1024, 128
TERMS = WORDS + SHAPES + BINS
RANK = 64
NEIGHBOURS = 25
BLOCK = 256
#: Code points of a text that are held as arrays at once.
PIECE = 1 << 20
#: Weights of the three kinds of terms, and of a vote by its cosine.
WEIGHT_WORDS, WEIGHT_SHAPES, WEIGHT_BINS, SHARPNESS = 0.3, 1.0, 1.0, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _outline() -> np.ndarray:
    """Of each code point below 2**16: 1 lower case letter, 2 upper case, 3 digit, 4 blank, 5 line end, else its own."""
    out = np.arange(1 << 16, dtype=np.uint64) + np.uint64(16)
    for c in range(1 << 16):
        x = chr(c)
        out[c] = 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdigit() else 5 if x == "\n" else 4 if x.isspace() else out[c]
    return out


_OUTLINE: list[np.ndarray] = []


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed terms of a whole text; an empty one has only its bins.

    The text goes through in pieces. What a piece leaves open goes on in the next: the last two runs of the outline, the
    word that isn't at its end, the two words before; so the counts are the same for pieces of any size.
    """
    _OUTLINE or _OUTLINE.append(_outline())
    counts, text = np.zeros(TERMS), text or ""
    totals = np.zeros(6)  # words, repeats of the word before, repeats of three words, upper, marks, characters
    runs, before = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    threes: list[np.ndarray] = []
    open_sum, open_letters = np.uint64(0), 0
    for i in range(0, len(text), PIECE):
        codes = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _OUTLINE[0][np.minimum(codes, (1 << 16) - 1)]
        solid = (kind != 4) & (kind != 5)
        totals[3:] += (kind == 2).sum(), ((kind > 5) & (kind < 150)).sum(), solid.sum()
        # the outline: runs of one kind collapse; its 3-grams
        kind = np.concatenate([runs[-2:], kind])
        runs = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
        if len(runs) >= 3:
            h = ((runs[:-2] * _A ^ runs[1:-1]) * _B ^ runs[2:]) * _A
            counts[WORDS : WORDS + SHAPES] += np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=SHAPES)
        # words by a sum of hashed letters at their places; the letters before the first start end the open word
        start = np.flatnonzero(solid & ~np.concatenate([[open_letters > 0], solid[:-1]]))
        begin = np.concatenate([[0], start])
        end = np.append(start, len(codes))
        place = np.arange(len(codes)) - np.repeat(begin, end - begin)
        place[: end[0]] += open_letters
        h = (codes.astype(np.uint64) + np.uint64(1)) * (_A + place.astype(np.uint64) * _B)
        upto = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(np.where(solid, h ^ (h >> np.uint64(29)), np.uint64(0)), out=upto[1:])
        sums = upto[end] - upto[begin]
        sums[:1] += open_sum
        last = bool(solid[-1])  # a word may go on
        letters = (open_letters if not len(start) else 0) + len(codes) - int(begin[-1])
        word = sums[0 if open_letters else 1 : len(sums) - last] * _A
        open_sum, open_letters = (sums[-1], letters) if last else (np.uint64(0), 0)
        before = _count_words(word, before, counts, totals, threes)
    if open_letters:
        _count_words(np.array([open_sum]) * _A, before, counts, totals, threes)
    totals[2] = sum(map(len, threes)) - len(_distinct(threes))
    n, chars = max(totals[0], 1), max(totals[5], 1)
    parts = [totals[1] / n, totals[2] / n, totals[3] / chars, totals[4] / chars, min(totals[0] / 2000, 1), min(chars / n / 20, 1)]
    for k, x in enumerate(parts):
        counts[WORDS + SHAPES + 20 * k + int(min(np.sqrt(x), 0.999) * 20)] = 1
    return counts


def _count_words(word: np.ndarray, before: np.ndarray, counts: np.ndarray, totals: np.ndarray, threes: list[np.ndarray]) -> np.ndarray:
    """Add whole words, which come after the words `before`, to the counts; returns the last two words."""
    counts[:WORDS] += np.bincount((word >> np.uint64(53)).astype(np.int64), minlength=WORDS)
    both = np.concatenate([before, word])
    totals[0] += len(word)
    totals[1] += (both[1:] == both[:-1]).sum() - (before[1:] == before[:-1]).sum()
    if len(both) >= 3:
        threes.append((both[:-2] * _A ^ both[1:-1]) * _B ^ both[2:])
    return both[-2:]


@dataclass
class Neighbours:
    """idf by term, terms x rank projection, unit vectors of labelled rows, and their labels."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, texts: list[str | None]) -> np.ndarray:
        """Unit latent vectors of texts, from their sparse counts."""
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for k, t in enumerate(texts):
            c = term_counts(t)
            at = np.flatnonzero(c)
            out[k] = _weigh(c[at], at, self.idf) @ self.project[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Votes for label 1, weighted by cosine; products of each text with every labelled vector, by blocks."""
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            cosine = self.embed(texts[i : i + BLOCK]) @ self.vectors.T
            near = _nearest(cosine, k)
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** SHARPNESS
            out[i : i + BLOCK] = (w * self.labels[near]).sum(1) / w.sum(1) if k else 0.5
        return np.clip(out, 0, 1)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row; of those as large as the k-th, the first ones."""
    if not k:
        return np.zeros((len(cosine), 0), int)
    least = np.partition(cosine, -k, axis=1)[:, -k, None]
    over, level = cosine > least, cosine == least
    room = k - over.sum(axis=1, keepdims=True)
    chosen = over | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
    return np.nonzero(chosen)[1].reshape(len(cosine), k)


def _weigh(counts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf of unit length within each kind of term."""
    x = np.log1p(counts) * idf[at]
    for low, high, weight in ((0, WORDS, WEIGHT_WORDS), (WORDS, WORDS + SHAPES, WEIGHT_SHAPES), (WORDS + SHAPES, TERMS, WEIGHT_BINS)):
        part = slice(*np.searchsorted(at, [low, high]))
        x[part] *= weight / max(float(np.linalg.norm(x[part])), 1e-12)
    return x


def fit_neighbours(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Neighbours:
    """Learn from about `rows` documents chosen among the labels by a hash of the key; those labels are sent to the
    documents. Executors count terms, the driver gets sparse counts of the sample and finds its leading singular
    vectors by randomised subspace iteration. Without rows every score is one half."""
    labels = labels.where(F.col(label).isin(0, 1))
    share = min(1.0, rows / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64(key, F.lit("knn")), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = docs.select(key, text).join(F.broadcast(chosen.select(key, label)), key)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(np.flatnonzero(c), c[c > 0]) for c in map(term_counts, batch["_text"])]
            yield pd.DataFrame({"key": batch["_key"], "label": batch["_label"], "at": [x for x, _ in found], "n": [y.astype(np.float32) for _, y in found]})

    sample = chosen.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(label).cast("int").alias("_label"))
    rowset = sample.mapInPandas(count, "key string, label int, at array<long>, n array<float>").toPandas().sort_values("key", ignore_index=True)
    x = np.zeros((len(rowset), TERMS), np.float32)
    for k, (at, n) in enumerate(zip(rowset["at"], rowset["n"], strict=True)):
        x[k, at] = n
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1)
    for k, at in enumerate(rowset["at"]):
        x[k, at] = _weigh(x[k, at].astype(float), np.asarray(at), idf)
    basis = np.random.default_rng(0).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    for _ in range(6):
        basis, _r = np.linalg.qr(x.T @ (x @ basis))
    left, size, right = np.linalg.svd(x @ basis, full_matrices=False)
    project = np.ascontiguousarray((basis @ right.T)[:, :RANK], np.float32)
    vectors = x @ project
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Neighbours(idf, project, np.ascontiguousarray(vectors), rowset["label"].to_numpy(float))


def score_quality(df: DataFrame, model: Neighbours, text: str = "text") -> DataFrame:
    """Add `score` double: the share of its neighbours' weight that has label 1.

    A null text counts as empty; an empty one is near the shortest labelled texts. Of neighbours that are as near, those
    whose keys come first by code point are preferred. A very long text counts whole. Equal texts get equal scores,
    repeated rows stay, an empty table stays empty; a column `score` that df has is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)))

    return with_columns(df, F.struct(score(F.col(text)).alias("score")), "score")


def op2_quality_knn(spark, sf_dir: str) -> DataFrame:
    """All documents; of a null doc_id `held_out` is null, and nothing is learned from its row."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = fit_neighbours(docs, known)
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
