"""Scores of texts by a log-bilinear neural model of words, learned by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from ..storage import Scratch
from .common import FOLDS, table, whole

#: Words that the neural model tells apart (the most frequent ones; all others are one class), and numbers of each.
VOCABULARY, WIDTH = 2048, 32
#: Words whose counts are sent to the texts; rarer ones are joined with theirs.
SENT_WORDS = 1 << 18
#: Longer words are known by a digest, so that no key is long.
LONG_WORD = 32
#: Tokens of a step, noise words that it shares, and the step's size.
STEP, NOISE, RATE = 1024, 64, 0.07
#: Bytes of text, about, that the common start is learned from, in one task; then every partition learns from all its texts.
START_BYTES = 8 << 20
#: Bytes of texts, about, whose words are held as arrays at once; a text stays whole.
PIECE = 8 << 20
#: Stands for the end of a text: no word has white space.
END = b"\n"
SMOOTH = 0.5


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + xxhash.xxh3_128_digest(word)


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lower-cased: the keys of the distinct ones, the number of its key for each word, and
    before which word each text begins, and the last one ends."""

    keys: pa.Array
    at: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Arrow's functions of ASCII work on bytes and know these characters only."""
        strings = texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(strings))
        flat, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
        filled = pc.binary_length(flat).to_numpy() > 0  # white space at the ends of a text leaves empty ones
        if not filled.all():
            flat, starts = flat.filter(pa.array(filled)), np.append(0, np.cumsum(filled))[starts]
        found = flat.dictionary_encode()
        keys = found.dictionary.cast(pa.binary())
        long = pc.greater(pc.binary_length(keys), LONG_WORD)
        if pc.any(long).as_py():
            keys = pc.replace_with_mask(keys, long, pa.array([word_key(w) for w in keys.filter(long).to_pylist()], pa.binary()))
        return cls(keys, found.indices.to_numpy(), starts)

    def numbers(self, known: pa.Array, unknown: int) -> np.ndarray:
        """Of each key its place among `known`."""
        return pc.index_in(self.keys, known).fill_null(unknown).to_numpy().astype(np.int64)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, about PIECE bytes of `text` at a time."""
    for batch in batches:
        if batch.num_rows:
            before = np.cumsum(np.append(0, pc.binary_length(batch["text"]).to_numpy()[:-1].astype(np.int64)))
            cuts = [*np.flatnonzero(np.diff(before // PIECE, prepend=-1)).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(i, j - i)


@dataclass
class Parameters:
    """Of each word: `seen`, its vector as context; `next`, as what follows; `bias`. `turn`: a matrix for each place of the
    context, by which its word's vector enters the prediction of the next word's. `energy`: of each of a word's three and of
    each row of a matrix the squared gradients so far, which shorten its steps."""

    seen: np.ndarray
    next: np.ndarray
    bias: np.ndarray
    turn: np.ndarray
    energy: tuple[np.ndarray, ...]

    @classmethod
    def start(cls, counts: np.ndarray, width: int, seed: int = 0) -> Parameters:
        """Small vectors, and the words' shares as biases: at first the model is that of single words."""
        random = np.random.default_rng(seed)
        small = lambda *shape: (random.standard_normal(shape) * 0.3 / np.sqrt(width)).astype(np.float32)
        turn = np.stack([np.eye(width, dtype=np.float32)] * 2) + small(2, width, width)
        energy = tuple(np.full(n, 1e-2, np.float32) for n in (*[len(counts)] * 3, (2, width)))
        return cls(small(len(counts), width), small(len(counts), width), np.log(_noise(counts)).astype(np.float32), turn, energy)

    def rows(self) -> np.ndarray:
        """All numbers as rows of one width: a word's, then those of the matrices."""
        words = np.concatenate([self.seen, self.next, self.bias[:, None], np.stack(self.energy[:3], 1)], 1)
        turn = np.concatenate([self.turn.reshape(-1, self.turn.shape[-1]), self.energy[3].reshape(-1, 1)], 1)
        return np.concatenate([words, np.pad(turn, ((0, 0), (0, words.shape[1] - turn.shape[1])))])

    @classmethod
    def from_rows(cls, rows: np.ndarray) -> Parameters:
        width = (rows.shape[1] - 4) // 2
        words, turn = rows[: -2 * width], rows[-2 * width :]
        parts = [x.copy() for x in (words[:, :width], words[:, width : 2 * width], words[:, 2 * width])]
        energy = (*(words[:, 2 * width + k].copy() for k in (1, 2, 3)), turn[:, width].reshape(2, width).copy())
        return cls(*parts, turn[:, :width].reshape(2, width, width).copy(), energy)


def _noise(counts: np.ndarray) -> np.ndarray:
    return (counts + SMOOTH) / (counts + SMOOTH).sum()


@dataclass
class _Groups:
    """The distinct numbers of a list (`which`), to add rows of the list up by number and to give each place its number's row."""

    at: np.ndarray
    order: np.ndarray
    head: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, lists: np.ndarray, kinds: int) -> Iterator[_Groups]:
        """Of each row of `lists`, sorted all at once; numbers are less than kinds."""
        order = np.argsort(lists.astype(np.uint16) if kinds <= 1 << 16 else lists, axis=1, kind="stable")
        ordered = np.take_along_axis(lists, order, 1)
        new = np.ones(lists.shape, bool)
        np.not_equal(ordered[:, 1:], ordered[:, :-1], out=new[:, 1:])
        for k in range(len(lists)):
            head = np.flatnonzero(new[k])
            yield cls(lists[k], order[k], head, ordered[k].take(head))

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Of each distinct number the sum of its rows. Two float32 are added as one complex number: half as many sums."""
        rows = rows.take(self.order, 0)
        if rows.shape[1] % 2:
            return np.add.reduceat(rows, self.head)
        return np.add.reduceat(rows.view(np.complex64), self.head).view(np.float32)

    def each(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each place of the list the row of its number; `place` is written over."""
        place[self.which] = np.arange(len(self.which))
        return rows.take(place.take(self.at), 0)


def _inverse_exp(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):  # the exponential of a large number: 0 is right
        np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(1), x, out=x)


def _contexts(texts: Iterable[np.ndarray], end: int) -> Iterator[np.ndarray]:
    """Steps of word numbers, several of one size at once: the word two before, the one before and the word, of each step and
    token. A text begins as if after two ends."""
    held, size = [], 0
    for words in texts:
        for i in range(0, len(words), 64 * STEP):  # long texts in pieces
            before = np.concatenate([np.full(max(0, 2 - i), end, np.int64), words[max(0, i - 2) : i + 64 * STEP]])
            held.append(np.stack([before[:-2], before[1:-1], before[2:]]))
            size += held[-1].shape[1]
        if size >= 64 * STEP:
            yield from _steps(held)
            held, size = [], 0
    if held:
        yield from _steps(held)


def _steps(held: list[np.ndarray]) -> Iterator[np.ndarray]:
    joined = np.concatenate(held, 1)
    joined = joined[:, np.random.default_rng(joined.shape[1]).permutation(joined.shape[1])]  # neighbours are alike
    full = joined.shape[1] // STEP * STEP
    for part in (joined[:, :full].reshape(3, -1, STEP), joined[:, None, full:]):
        if part.size:
            yield part


def train(model: Parameters, texts: Iterable[np.ndarray], counts: np.ndarray, end: int, seed: int = 0) -> tuple[Parameters, int]:
    """One pass over texts of word numbers; the parameters after it, and how many tokens it has seen.

    Noise-contrastive estimation: a logistic loss tells each word from NOISE words drawn by the words' shares, which the
    tokens of a step have in common, so that scores are matrix products. Steps shrink number by number as gradients sum up.
    A step's products with the matrices, and their gradients, take a row for each distinct word, not for each token. A bias,
    less the logarithm of the word's share of noise, is one more number of the word's vector, times a number 1 of the context's.
    """
    random, share = np.random.default_rng(seed), _noise(counts)
    cumulated, log_share = np.cumsum(share), np.log(share * NOISE).astype(np.float32)
    seen, turn, energy = model.seen.copy(), model.turn.copy(), tuple(e.copy() for e in model.energy)
    kinds, width = seen.shape
    nxt = np.zeros((kinds, width + 1 + (width + 1) % 2), np.float32)  # of an even width, for sums
    nxt[:, :width], nxt[:, width] = model.next, model.bias - log_share
    g_seen, place, tokens = np.empty_like(seen), np.empty(kinds, np.int64), 0

    def shorten(e: np.ndarray, at, gradient: np.ndarray) -> np.ndarray:
        e[at] = now = e[at] + (np.einsum("...i,...i", gradient, gradient) / gradient.shape[-1])
        gradient *= (RATE / np.sqrt(now))[..., None]
        return gradient

    for block in _contexts(texts, end):
        tokens += block[0].size
        steps, n = block.shape[1:]
        noises = np.minimum(np.searchsorted(cumulated, random.random((steps, NOISE))), kinds - 1)
        groups = zip(*(_Groups.of(x, kinds) for x in (block[0], block[1], np.concatenate([block[2], noises], 1))), strict=True)
        h, rows, g_false = (np.zeros(x, np.float32) for x in ((n, nxt.shape[1]), (n + NOISE, nxt.shape[1]), (n, NOISE)))
        h[:, width] = 1
        for word, noise, (by_two, by_one, by_next) in zip(block[2], noises, groups, strict=True):
            a, b = seen.take(by_two.which, 0), seen.take(by_one.which, 0)
            np.add(by_two.each(a @ turn[0], place), by_one.each(b @ turn[1], place), out=h[:, :width])
            own, other = nxt.take(word, 0), nxt.take(noise, 0)
            g_true = -_inverse_exp(np.einsum("ij,ij->i", h, own))[:, None]
            _inverse_exp(np.matmul(h, -other.T, out=g_false))
            np.multiply(g_true, h, out=rows[:n])
            np.matmul(g_false.T, h, out=rows[n:])
            own *= g_true
            g_h = g_false @ other[:, :width]
            g_h += own[:, :width]
            g_two, g_one, g_next = by_two.sums(g_h), by_one.sums(g_h), by_next.sums(rows)
            shorten(energy[1], by_next.which, g_next[:, :width])
            shorten(energy[2], by_next.which, g_next[:, width : width + 1])
            nxt[by_next.which] -= g_next
            g_seen[by_one.which] = 0
            g_seen[by_two.which] = g_two @ turn[0].T
            g_seen[by_one.which] += g_one @ turn[1].T
            used = np.zeros(kinds, bool)
            used[by_two.which] = used[by_one.which] = True
            at = np.flatnonzero(used)
            turn -= shorten(energy[3], slice(None), np.stack([a.T @ g_two, b.T @ g_one]))
            seen[at] -= shorten(energy[0], at, g_seen.take(at, 0))
    return Parameters(seen, nxt[:, :width].copy(), nxt[:, width] + log_share, turn, energy), tokens


@dataclass
class Tables:
    """What each word adds to the score of each next word from its place, bias included, and the logarithm of what all next
    words' exponentials sum to, for each context."""

    two: np.ndarray
    one: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, model: Parameters) -> Tables:
        """A score is a sum over the places of the context, so its exponential is a product, and the sums of all contexts
        are one product of two matrices."""
        two = (model.seen @ model.turn[0] @ model.next.T).astype(np.float32)
        one = (model.seen @ model.turn[1] @ model.next.T + model.bias).astype(np.float32)
        high = [x.max(1, keepdims=True) for x in (two, one)]
        sums = np.exp(two - high[0]) @ np.exp(one - high[1]).T
        with np.errstate(divide="ignore"):
            total = np.log(sums) + high[0] + high[1].T
        for i, j in zip(*np.nonzero(sums < 1e-30), strict=True):  # too small for these numbers
            z = two[i].astype(float) + one[j]
            total[i, j] = z.max() + np.log(np.exp(z - z.max()).sum())
        return cls(two, one, total)

    def log10(self, words: np.ndarray, end: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Of each word its normalised log10 probability after the two before it: of one text, or of several in a row, of which
        each begins at one of `starts` and ends with `end`."""
        before = np.concatenate([[end, end], words])
        i, j = before[:-2].copy(), before[1:-1]
        if starts is not None:
            i[starts] = end
        return (self.two[i, words].astype(float) + self.one[j, words] - self.total[i, j]) / np.log(10)


@dataclass
class Language:
    """A learned model: the most frequent words in order and their counts, the neural parameters of the first ones and of
    one class for all others, and the sums over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    parameters: Parameters | None
    size: int  # words that the parameters tell apart; number `size` is the class of all others
    tokens: int
    kinds: int

    @property
    def class_counts(self) -> np.ndarray:
        return np.append(self.counts[: self.size], self.tokens - int(self.counts[: self.size].sum())).astype(float)

    def numbers(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    def base_total(self) -> float:
        return self.tokens + SMOOTH * (self.kinds + 1)

    def other_total(self) -> float:
        """Of the class of other words, and of words never seen, which count as one word."""
        return self.class_counts[-1] + SMOOTH * (self.kinds - self.size + 1)


def _is_training(doc_id: Column) -> Column:
    """Null ids are learned from: no remainder says that they are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 1, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """`word` (its key) and `n` over all texts (column `text`, binary), their ends included."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in _pieces(batches):
            words = Words.of(batch["text"])
            n = np.bincount(words.at, minlength=len(words.keys))
            held += [pa.table({"word": w, "n": pa.array(k, pa.int64())}) for w, k in ((words.keys, n), (pa.array([END], pa.binary()), [batch.num_rows]))]
            if sum(map(len, held)) > 1 << 20:
                held = [summed(held)]
                if len(held[0]) > 1 << 19:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(batches: Iterable[pa.RecordBatch], words: pa.Array, end: int) -> Iterator[np.ndarray]:
    """The numbers of each text's words, their places among `words` or the number after all these, and of its end."""
    for batch in _pieces(batches):
        found = Words.of(batch["text"])
        at = found.numbers(words, len(words)).take(found.at)
        for i, j in zip(found.starts[:-1].tolist(), found.starts[1:].tolist(), strict=True):
            yield np.append(at[i:j], end)


def fit_language(texts: DataFrame, vocabulary: int = VOCABULARY, width: int = WIDTH, sent: int = SENT_WORDS, start_bytes: int = START_BYTES) -> tuple[Language, DataFrame]:
    """The model of all texts (column `text`, binary), and the counts of all their words (`word`, `n`).

    Counts are over all texts. The neural model starts from one task's pass over about `start_bytes` of them, chosen by
    hash; from there each partition passes over all its texts, and the mean of their parameters, weighted by tokens, is
    the model: one row of numbers for each word and partition is summed by Spark, so no task holds more than a model or two.
    """
    spark, scratch = texts.sparkSession, Scratch(texts.sparkSession, "language")
    counts = scratch.write("counts", word_counts(texts))
    whole_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    top = _most_frequent(counts, sent)
    if not whole_["kinds"]:
        return Language([END], np.zeros(1, np.int64), None, 1, 0, 0), counts
    words, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    if END not in words:
        words, n = [*words, END], np.append(n, counts.where(F.col("word") == F.lit(bytearray(END))).first()["n"])
    model = Language(words, n, None, min(vocabulary, len(words)), whole_["tokens"], whole_["kinds"])
    first = Parameters.start(model.class_counts, width)
    bytes_ = texts.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"]
    few = texts.where(F.pmod(F.xxhash64("text", F.lit("start")), F.lit(1 << 20)) < int(min(1.0, start_bytes / max(bytes_, 1)) * (1 << 20)))
    model.parameters = _pass(few.coalesce(1), model, first)
    model.parameters = _pass(texts, model, model.parameters)
    return model, counts


def _most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """Up to `most` of the most frequent words, in order: all that have a count over the highest bound, of a few hundred,
    that leaves no more. Sorting all words for it would send the first `most` of every partition to one place."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    left = most
    for row in counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():
        if row["count"] > left:
            counts = counts.where(grade > row["grade"])
            break
        left -= row["count"]
    return counts.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def _pass(texts: DataFrame, model: Language, parameters: Parameters) -> Parameters:
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((parameters, model.words[: model.size], model.class_counts))
    columns = [f"x{k}" for k in range(parameters.rows().shape[1])]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words, counts = shared.value
        end = words.index(END) if END in words else len(words)
        found, tokens = train(start, _numbered(batches, pa.array(words, pa.binary()), end), counts, end)
        if tokens:
            rows = found.rows().astype(float) * tokens
            more = [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), tokens), pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(rows.T)), *more], names=[*columns, "row", "tokens"])

    learned = texts.mapInArrow(learn, ", ".join(f"{c} double" for c in columns) + ", row int, tokens long")
    sums = learned.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns], F.sum("tokens").alias("tokens")).toPandas().sort_values("row")
    if not len(sums):
        return parameters
    return Parameters.from_rows((sums[columns].to_numpy() / sums["tokens"].to_numpy()[:, None]).astype(np.float32))


def _scorer(shared) -> tuple:
    """What a worker makes once of a model: words, tables, logarithms of their shares, alone and in their class."""
    if getattr(shared, "_scorer", None) is None:
        model = shared.value
        logs = np.log10((model.counts + SMOOTH) / model.base_total()) if model.tokens else np.zeros(len(model.counts))
        other = np.log10((model.counts[model.size :] + SMOOTH) / model.other_total())
        shared._scorer = model, pa.array(model.words, pa.binary()), Tables.of(model.parameters) if model.parameters else None, logs, other
    return shared._scorer


def _by_text(row: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Of n texts the sum of their words' values, by each word's text and its place among the values."""
    return np.bincount(row, values.take(at), n)


def score_texts(df: DataFrame, model: Language, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: key, `n_tokens`, `n_known`, `train_tokens` long, `base_score`, `score` double.

    base_score: of single words, by their counts. score: by the neural model for its own words and the class of all others,
    whose words share the class's probability by their counts; words never seen count as one word of it. Both are sums
    over a text's words and its end. A null or empty text has its end alone. Very long texts are scored whole. Repeated
    rows and null keys keep rows of their own, equal texts get equal scores; an empty table stays empty; where nothing was
    learned, every token has probability 1. Other columns of df play no part.
    Words that weren't sent are joined with their counts, a row for each text and word, and summed again by text.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "scored")
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbered, tables, logs, other = _scorer(shared)
        size, end = held.size, held.words.index(END)
        for batch in _pieces(batches):
            words, n = Words.of(batch["text"]), batch.num_rows
            tokens = np.diff(words.starts) + 1
            row = np.repeat(np.arange(n), tokens - 1)
            number = words.numbers(numbered, -1)
            sent, new = number >= 0, number >= size
            known = _by_text(row, words.at, sent & (held.counts.take(number) > 0), n) + (held.counts[end] > 0)
            base = line = _by_text(row, words.at, np.where(sent, logs.take(number), 0), n) + logs[end]
            if tables is not None:
                classes = np.full(tokens.sum(), min(end, size))  # of all words and ends; all but the ends follow
                classes[np.arange(len(row)) + row] = np.where(sent, np.minimum(number, size), size).take(words.at)
                line = np.bincount(np.repeat(np.arange(n), tokens), tables.log10(classes, min(end, size), words.starts[:-1] + np.arange(n)), n)
                line += _by_text(row, words.at, np.append(other, 0).take(np.where(new, number - size, -1)), n) + (other[end - size] if end >= size else 0)
            rare = np.flatnonzero(~sent.take(words.at))
            pairs, times = np.unique(row.take(rare) * len(words.keys) + words.at.take(rare), return_counts=True)
            starts = np.searchsorted(pairs, np.arange(n + 1) * len(words.keys)).astype(np.int32)
            which = words.keys.take(pa.array(pairs % max(1, len(words.keys))))
            lists = [pa.ListArray.from_arrays(starts, x) for x in (which, pa.array(times, pa.int64()))]
            columns = [pa.array(x, t) for x, t in zip((tokens, known.astype(np.int64), base, line), types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns, *lists], names=["key", *names])

    names = ["n_tokens", "n_known", "base_score", "score", "words", "times"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    rows = df.select(F.col(f"`{key}`").alias("key"), whole(F.col(f"`{text}`")).cast("binary").alias("text"))
    schema = StructType([StructField("key", kind), *(StructField(n, from_arrow_type(t)) for n, t in zip(names, types, strict=True))])
    # written once, so that each row keeps its number
    sums = scratch.write("sums", rows.mapInArrow(score, schema).withColumn("uid", F.monotonically_increasing_id()))
    rare = sums.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", "x.words", "x.times")
    n = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10((n + SMOOTH) / F.lit(model.base_total())) if model.tokens else F.lit(0.0)
    line = F.log10((n + SMOOTH) / F.lit(model.other_total())) if model.parameters else base
    rare = rare.join(counts.select(F.col("word").alias("words"), "n"), "words", "left").groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * base).alias("base_score"), F.sum(F.col("times") * line).alias("score")
    )
    more = [(F.col(f"s.{c}") + F.coalesce(F.col(f"r.{c}"), F.lit(0))).alias(c) for c in ("n_known", "base_score", "score")]
    both = sums.alias("s").join(rare.alias("r"), "uid", "left").select("s.key", F.col("s.n_tokens"), *more)
    return both.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_language_model(spark, sf_dir: str) -> DataFrame:
    """All documents, by what those outside the held-out fifth say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit_language(docs.where(_is_training(F.col("doc_id"))).select(whole(F.col("text")).cast("binary").alias("text")))
    held = (~_is_training(F.col("doc_id"))).alias("held_out")
    return score_texts(docs, model, counts).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
