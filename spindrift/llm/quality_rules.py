"""Quality rules: lines first, then the document by what is left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SYMBOLS, table, whole, words

#: Marks that a sentence or clause ends with, in several scripts.
ENDS = r"[.!?…:;,。！？；，।؟۔]"
#: Marks between the items of a menu.
BARS = "[|»›•→]"
MARKS = "[#*$%&|<>!»›•→]"
#: Phrases of menus and page furniture.
NAVIGATION = r"(?i)\b(click here|read more|next page|previous page|back to top|skip to content|sign in|log in|site map|main menu|share this)\b"
#: Phrases of standing notices.
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|enable javascript|lorem ipsum|unsubscribe)"
#: A document that lost more than this share of its words is rejected.
MOST_LOST = 0.4


#: Bits of a window's place in its text; the rest of a long holds its hash.
PLACE = 24


def _count(text: Column, chars: str) -> Column:
    """How many characters of the class `chars` a text has."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))


def _facts(line: Column) -> Column:
    """The line, its words, and how many of the marks that the rules count it has."""
    return F.struct(line.alias("line"), words(line).alias("w"), _count(line, MARKS).alias("marks"))


def _fails(x: Column) -> Column:
    """True for a line that the rules remove; an empty line fails none.

    Punctuation: over 8 words without a mark that ends a clause; or symbols, or exclamation marks, for more than
    a third of the words. Navigation: three or more bars or arrows between short items, or a menu phrase in a line of
    12 words at most. Boilerplate: a notice's phrase in a line of 40 words at most.
    """
    line, n, marks = x["line"], F.size(x["w"]), x["marks"]
    loud = (n > 2) & (3 * marks > n) & ((3 * _count(line, SYMBOLS) > n) | (3 * _count(line, "!") > n))
    punctuation = ((n > 8) & ~line.rlike(ENDS)) | loud
    navigation = ((marks >= 3) & (_count(line, BARS) >= 3) & (4 * _count(line, BARS) > n)) | ((n <= 12) & line.rlike(NAVIGATION))
    boilerplate = (n <= 40) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def _word(i: Column) -> Column:
    return F.get(F.col("_w"), i)


def _windows(make) -> Column:
    """Of the words in `_w`, make(i) for each 3-word window's place i."""
    places = F.slice(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), 1, F.greatest(F.size("_w") - 2, F.lit(0)))
    return F.transform(places, make)


def _hash(i: Column) -> Column:
    return F.xxhash64(_word(i), _word(i + 1), _word(i + 2))


def _like_neighbour(step: int) -> Column:
    """Those of `_s`, sorted longs of hash and place, whose next (1) or previous (-1) has the same hash.

    The k-th of the one list and the k-th of the other are neighbours.
    """
    return F.filter("_s", lambda x, j: F.shiftright(x, PLACE) == F.shiftright(F.get(F.col("_s"), j + step), PLACE))


def _place(x: Column) -> Column:
    return x.bitwiseAND(2**PLACE - 1).cast("int")


def _collides() -> Column:
    """Whether neighbours share a hash but not their words, or places are too large to pack."""
    unlike = lambda i, j: (_word(i) != _word(j)) | (_word(i + 1) != _word(j + 1)) | (_word(i + 2) != _word(j + 2))
    pairs = F.zip_with("_one", "_other", lambda x, y: unlike(_place(x), _place(y)))
    return (F.size("_w") >= 2**PLACE) | F.array_contains(pairs, True)


def _places_by_words() -> Column:
    """The same by comparing words alone, for the rare text in which hashes collide."""
    s = F.sort_array(_windows(lambda i: F.struct(_word(i).alias("a"), _word(i + 1).alias("b"), _word(i + 2).alias("c"), i.alias("i"))))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    return F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"])


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """One row per row of df: key, counts, `base_failed`, `kept`, `words_left` long, `text_left`.

    `text_left` is the text without the lines that fail; it is not kept if over `most_lost` of its words are gone or
    if the base rules fail. Null and empty texts have no words and fail. Everything is done within a row: very long texts
    count whole, repeated rows and null keys keep rows of their own, equal texts get equal verdicts, and an empty table gives
    an empty one. Columns of df that aren't named play no part.

    Repeated words: 3-word windows are sorted by hash, so equal ones are neighbours, and compared in full; a word
    counts once however many repeated windows cover it.
    """
    body = whole(F.col(text))
    a = df.select(F.col(key), F.transform(F.split(body, "\n"), _facts).alias("_l"))
    a = a.select(key, "_l", F.flatten(F.transform("_l", lambda x: x["w"])).alias("_w"))
    packed = lambda i: F.shiftleft(_hash(i), PLACE).bitwiseOR(i.cast("long"))
    b = a.select(
        key, "_w", "_l",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.aggregate("_l", F.lit(0).cast("long"), lambda s, x: s + F.when(x["marks"] > 0, _count(x["line"], SYMBOLS)).otherwise(F.lit(0))).alias("n_symbols"),
        F.sort_array(_windows(packed)).alias("_s"),
    )
    lines = F.transform(F.filter("_l", lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
    c = b.select(
        key, "_w", "word_chars", "n_symbols",
        lines.alias("_lines"),
        F.filter("_l", lambda x: ~_fails(x)).alias("_kept"),
        _like_neighbour(1).alias("_one"),
        _like_neighbour(-1).alias("_other"),
    )
    by_hash = F.array_distinct(F.transform(F.concat("_one", "_other"), _place))
    c = c.withColumn("_p", F.sort_array(F.when(_collides(), _places_by_words()).otherwise(by_hash)))
    step = F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(3))))
    left = F.array_join(F.transform("_kept", lambda x: x["line"]), "\n")
    d = c.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
        F.aggregate("_kept", F.lit(0).cast("long"), lambda s, x: s + F.size(x["w"])).alias("words_left"),
        left.alias("text_left"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("n_words") - F.col("words_left") > F.lit(most_lost) * F.col("n_words")
    return d.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "words_left", "text_left",
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text_left")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS m,
        m AS n,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS s, length(line) - length(replace(line, '!', '')) AS e,
        length(line) - length(regexp_replace(line, '[|»›•→]', '', 'g')) AS b FROM l),
x AS (SELECT doc_id, sum(m)::BIGINT AS words_left FROM f WHERE NOT (
        (n > 8 AND NOT regexp_matches(line, '[.!?…:;,。！？；，।؟۔]')) OR (n > 2 AND 3 * greatest(s, e) > n)
        OR (b >= 3 AND 4 * b > n)
        OR (n <= 12 AND regexp_matches(line, '(?i)\b(click here|read more|next page|previous page|back to top|skip to content|sign in|log in|site map|main menu|share this)\b'))
        OR (n <= 40 AND regexp_matches(line, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|enable javascript|lorem ipsum|unsubscribe)')))
      GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(words_left, 0) AS words_left
      FROM d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - words_left > 0.4::DOUBLE * n_words) AS kept, words_left
FROM b
"""
