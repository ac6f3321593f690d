"""Phrases whose words stand together more often than their parts suggest, mined by generalised suffix automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, whole
from .shingles import _A, _mix
from .suffix_automaton import suffix_automaton

#: Words of the longest phrase; the fewest occurrences of one; a longer phrase with so many percent of them replaces it.
LONGEST, LEAST, COVERED = 3, 10, 50
SCALE = 1_000_000
#: Bytes of text, about, that one automaton is made of.
SHARD_BYTES = 2 << 20
#: Bits of the filter of frequent pairs: BITS_EACH for each, in these bounds. What passes by chance is counted, no more.
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Characters that end a piece, and those that part words.
_TO_GAP, _TO_BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_PARTS = frozenset(_TO_GAP + _TO_BLANK)
_CLASSES = bytes.maketrans(_TO_GAP + _TO_BLANK, b"\n" * len(_TO_GAP) + b" " * len(_TO_BLANK))


def _groups(texts: Iterable[bytes]) -> Iterator[bytes]:
    """Texts joined, a line end between two, until there are SHARD_BYTES."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= SHARD_BYTES:
            yield b"\n".join(group)
            group, size = [], 0
    yield b"\n".join(group)


def _tokens(texts: Iterable[bytes], context: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of texts, A-Z lower-cased, in lists of bounded size, a line end where no phrase reaches over; and how
    many at the start of a list are the last ones of the list before, for context only."""
    for data in _groups(texts):
        start, before = 0, []
        while start < len(data):
            stop = min(len(data), start + SHARD_BYTES)
            if stop < len(data):  # a list ends between words
                stop = next((i for i in range(stop, len(data)) if data[i] in _PARTS), len(data))
            own = before + [w for w in data[start:stop].translate(_CLASSES).lower().replace(b"\n", b" \n ").split(b" ") if w]
            if len(own) > len(before):
                yield own, len(before)
            start, before = stop, own[-context:]


def _shards(batches: Iterator[pd.DataFrame], context: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """Language, distinct words, their numbers along the texts (-1: a gap), places of context."""
    for batch in batches:
        for lang, part in batch.groupby("lang", sort=False):
            for tokens, skip in _tokens(part["text"], context):
                numbers = dict.fromkeys(tokens)
                numbers.pop(b"\n", None)
                found = list(numbers)
                numbers = {w: k for k, w in enumerate(found)} | {b"\n": -1}
                yield lang, found, np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), skip


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first * _A) + second)


def _frequent_pairs(docs: DataFrame, least: int) -> np.ndarray:
    """A filter that every pair of words with `least` occurrences passes, as bits in 64-bit numbers, of bounded size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, symbols, skip in _shards(batches, 1):
            end, n = suffix_automaton(symbols, 2, skip).substrings(2)
            hashed = _word_hashes(lang, words)
            yield pd.DataFrame({"h": _pair_hashes(hashed[symbols[end - 1]], hashed[symbols[end]]).view(np.int64), "n": n})

    pairs = docs.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = materialise(pairs.select("h"), "phrases-pairs")
    size = FEWEST_BITS
    n = pairs.count()
    while size < min(BITS_EACH * n, MOST_BITS):
        size *= 2
    bit = F.col("h").bitwiseAND(size - 1)
    bits = pairs.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast((h & {size - 1}L) & 63 AS INT))").alias("bits"))
    found = bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`lang`, `phrase`, `words` (0 to 3), `n`: how often each phrase of up to 3 words stands in the pieces of a language's
    texts, for all with `least` occurrences and more; the phrase of no words stands at each word. docs: lang, text (binary).

    A shard's automaton gives each class of substrings with the same end places once, with their number; Spark sums what
    the shards have. A phrase is as rare as its rarest pair, so longer ones are sent only where all pairs pass the filter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_pairs(docs, least))

    def enumerate_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for lang, words, symbols, skip in _shards(batches, LONGEST - 1):
            automaton, hashed = suffix_automaton(symbols, LONGEST, skip), _word_hashes(lang, words)
            phrases, sizes, counts = [b""], [0], [int(automaton.count[0])]
            for size in range(1, LONGEST + 1):
                end, n = automaton.substrings(size)
                for k in range(1, size):
                    left, right = symbols[end - k], symbols[end - k + 1]
                    keep = _passes(bits, _pair_hashes(hashed[left], hashed[right]))
                    end, n = end[keep], n[keep]
                parts = [symbols[end - k].tolist() for k in range(size - 1, -1, -1)]
                phrases += [b" ".join([words[i] for i in p]) for p in zip(*parts, strict=True)]
                sizes += [size] * len(n)
                counts += n.tolist()
            yield pd.DataFrame({"lang": lang, "phrase": phrases, "words": sizes, "n": counts})

    found = docs.mapInPandas(enumerate_, "lang string, phrase binary, words int, n long")
    found = found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("n").alias("n"))
    return materialise(found.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases-counts")


def _part(phrase: Column, words: int) -> Column:
    """The first words of a phrase, or the last where the number is negative."""
    return F.substring_index(phrase, " ", words)


def mine_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = 2000) -> DataFrame:
    """The `top` phrases of two and three words of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    A null text counts as empty, a null language as `und`; texts without words give nothing, nor does an empty table. Very
    long texts are read in pieces that overlap, so nothing is lost or counted twice. Repeated rows count as often as they
    stand. Ties go by the phrase's bytes, so the order is total. Other columns of df play no part.

    Each phrase scores by the cut at which its halves explain it best: floor(10^6 a^2 / (l r)), in decimals of 38 digits.
    A suffix link of the automata leads from a phrase to it without its first word; over these, and over their mirror
    images without the last word, a phrase tells the shorter ones how often it stands, and they go if that is enough.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), whole(F.col(f"`{text}`")).cast("binary").alias("text"))
    counts = phrase_counts(docs, least)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(_part(F.col("phrase"), -2), _part(F.col("phrase"), 2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))
    cuts = F.filter(F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda k: k < F.col("words"))
    kept = kept.select("lang", "phrase", "words", "a", F.explode(cuts).alias("k"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - words)")
    kept = kept.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    left = counts.where("words > 0").select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.where("words > 0").select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = kept.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = F.expr(f"cast((cast(a AS DECIMAL(38, 0)) * a * {SCALE}) div (cast(l AS DECIMAL(38, 0)) * r) AS LONG)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    all_words = counts.where("words = 0").select("lang", "n")
    return ranked.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return mine_phrases(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM ws
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM ws
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM ws),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
covered AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3),
kept AS (SELECT * FROM c ANTI JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase AND 100 * v.a >= {COVERED} * c.a),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM kept
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
scored AS (
  SELECT cuts.*, x.n AS l, y.n AS r, ({SCALE}::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
