"""Similarity self-join on word n-grams: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..storage import Scratch, small_batches
from .common import partitions, table, with_ids
from .shingles import shingle_set

#: Parts that the suffix filter counts.
PARTS = 256
#: Columns of 64 parts each, of which they say whether an odd number of n-grams is in them; the join itself filters by them.
BRIEFS = [f"brief{k}" for k in range(PARTS // 64)]
#: n-grams whose counts the tasks get to know, at most: the most frequent ones, of those that LEAST sets or more hold.
FREQUENT, LEAST = 1 << 17, 8
#: n-grams, eight bytes each, that a task holds before it packs them.
HELD = 1 << 21
#: Entries of prefixes, 24 bytes each, that a task holds before it passes them on.
PASSED = 1 << 16
#: Documents to verify, eight bytes each, up to which their ids are sent to the texts.
SENT = 1 << 22
#: Pairs to verify, of four numbers, up to which they are sent to the sets.
SENT_PAIRS = 1 << 18
#: Rows of an n-gram for which one task pairs them with others; more are dealt over several.
SALTED = 1000


def _prefix(n: int, share: int) -> int:
    """So many of the rarest n-grams that two sets of similarity share / 100 must have one in common."""
    return n - -(-share * n // 100) + 1 if n else 0


def _needed(a: Column, b: Column, share: int) -> Column:
    """The least intersection of two sets of these sizes: 100 I >= share (a + b - I)."""
    return F.ceil((F.lit(share) * (a + b)).cast("double") / (100 + share) - 1e-9)


def _survey(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Per document: size, digest of its set, counts by part and whether they are odd; and, packed by their first `bits` bits, the
    next 32 bits of all its n-grams."""

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        s = np.concatenate(held)
        held.clear()  # there are many, so few copies of them are made
        s.sort()
        of = s >> np.uint64(64 - bits)
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        buckets = of[at].astype(np.int64)
        del of
        s >>= np.uint64(32 - bits)
        low = s.astype("<u4")  # its last 32 bits
        return pd.DataFrame({"id": -1, "n": 0, "digest": None, "parts": None, **dict.fromkeys(BRIEFS, 0), "bucket": buckets, "grams": [x.tobytes() for x in np.split(low, at[1:])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            rows = []
            for k, t in zip(batch["id"], batch["text"], strict=True):
                s = shingle_set(t, words)
                parts = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                briefs = np.packbits((parts & 1).astype(np.uint8)).view("<i8").tolist()
                parts = parts.clip(max=65535).astype("<u2").tobytes()
                rows.append((k, len(s), hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest(), parts, *briefs, -1, None))
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield packed(held)
                    size = 0
            yield pd.DataFrame(rows, columns=["id", "n", "digest", "parts", *BRIEFS, "bucket", "grams"])
        if size:
            yield packed(held)

    return docs.mapInPandas(run, f"id long, n long, digest binary, parts binary, {', '.join(f'{b} long' for b in BRIEFS)}, bucket int, grams binary")


def _frequent(packed: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (their first bits + 32 bits, sorted) that most sets hold, and how many do: counted over all documents.

    A task counts the buckets dealt to it one after the other and reports its FREQUENT most frequent n-grams; the least
    count that FREQUENT n-grams in all have comes from a histogram of counts, so the driver gets no more than these.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bucket, held = None, []

        def add() -> None:
            nonlocal grams, counts
            s, n = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
            often = n >= LEAST
            grams = np.concatenate([grams, (s[often].astype(np.int64)) | (int(bucket) << 32)])
            counts = np.concatenate([counts, n[often]])
            if len(grams) > 2 * FREQUENT:
                most = np.argpartition(-counts, FREQUENT)[:FREQUENT]
                grams, counts = grams[most], counts[most]

        for batch in batches:
            for b, g in zip(batch["bucket"], batch["grams"], strict=True):
                if b != bucket and held:
                    add()
                    held = []
                bucket = b
                held.append(g)
        if held:
            add()
        yield pd.DataFrame({"gram": grams, "c": counts})

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "grams")
    counts = scratch.write("counts", dealt.mapInPandas(count, "gram long, c long"))
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step"))
    least, room = None, FREQUENT
    for r in steps.collect():  # a few hundred steps at most
        if r["n"] > room:
            break
        least, room = r["least"], room - r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    listed = counts.where(F.col("c") >= int(least)).toArrow()
    grams, n = listed["gram"].to_numpy().astype(np.uint64), listed["c"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _prefixes(docs: DataFrame, words: int, share: int, frequent: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """Rows of each document's prefix: n-gram, document, size of its set, place in its order. First come the n-grams that
    aren't frequent, by their hashes, then the frequent ones, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def entries(out: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("gram", "id", "n", "place"), zip(*out, strict=True), strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = shared.value
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for k, t in zip(batch["id"], batch["text"], strict=True):
                s = shingle_set(t, words)
                p = _prefix(len(s), share)
                often = np.zeros(len(s), np.int64)
                if len(grams):
                    short = s >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(grams, short), len(grams) - 1)
                    often = np.where(grams[at] == short, counts[at], 0)
                first = s[np.argsort(often, kind="stable")[:p]]
                out.append((first.view(np.int64), np.full(p, k), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
                size += p
                if size >= PASSED:
                    yield entries(out)
                    out, size = [], 0
        if out:
            yield entries(out)

    return docs.mapInPandas(run, "gram long, id long, n int, place int")


def _briefs_agree(most: Column) -> Column:
    """Suffix filter of an entry and another one (`other_` before the names), inside the join: a part that is odd in one set
    only holds an n-gram that the other lacks, or the other way."""
    apart = [F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in BRIEFS]
    return sum(apart[1:], apart[0]) <= most


@F.pandas_udf(T.BooleanType())
def _parts_agree(x: pd.Series, y: pd.Series, most: pd.Series) -> pd.Series:
    """Suffix filter: what two sets differ by is at least the sum of the differences of their parts' sizes."""
    if not len(x):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(s), "<u2").reshape(-1, PARTS).astype(np.int32) for s in (x, y))
    return pd.Series(np.abs(a - b).sum(1) <= most.to_numpy())


@F.pandas_udf(T.LongType())
def _common(x: pd.Series, y: pd.Series) -> pd.Series:
    sets = ((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(x, y, strict=True))
    return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], dtype="int64")


def _linked(name: str, pairs: DataFrame, info: DataFrame, docs: DataFrame, words: int, share: int, scratch: Scratch) -> DataFrame:
    """Of distinct candidate pairs a, b those that link, as table `name`. Each pair passes the suffix filter and is verified
    once, on the sets made anew from the texts of those documents only."""
    side = lambda c: info.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.col("n_a") + F.col("n_b") - 2 * _needed(F.col("n_a"), F.col("n_b"), share)
    pairs = scratch.write(f"{name}-pairs", pairs.where(_parts_agree("parts_a", "parts_b", most)).select("a", "b", "n_a", "n_b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()

    ids = scratch.write(f"{name}-ids", ids)
    if ids.count() <= SENT:  # as one sorted array; beyond, texts are joined
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))
        chosen = docs
    else:
        wanted, chosen = None, docs.join(ids, "id", "left_semi")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if wanted is not None:
                batch = batch[np.isin(batch["id"].to_numpy(), wanted.value)]
            yield pd.DataFrame({"id": batch["id"], "grams": [shingle_set(t, words).astype("<u8").tobytes() for t in batch["text"]]})

    sets = scratch.write(f"{name}-sets", chosen.mapInPandas(make, "id long, grams binary"))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}"))
    pairs = F.broadcast(pairs) if pairs.count() <= SENT_PAIRS else pairs
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", _common("grams_a", "grams_b"))
    both = both.where(100 * F.col("common") >= share * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")
    links = scratch.write(name, both)
    scratch.empty(f"{name}-pairs", f"{name}-ids", f"{name}-sets")
    return links


def _may_link(share: int) -> Column:
    """Length and positional filter of entries (n, place) and (m, at): what is left of both sets can still be enough."""
    n, m, i, j = F.col("n"), F.col("m"), F.col("place"), F.col("at")
    return (100 * F.least(n, m) >= share * F.greatest(n, m)) & (1 + F.least(n - i - 1, m - j - 1) >= _needed(n, m, share))


def _other_pairs(placed: DataFrame, share: int) -> DataFrame:
    """Candidate pairs a, b of entries (gram, id, n, place, c, lc, group, BRIEFS) whose components c differ.

    Of a pair that links the smaller set (by size, then id) holds a common n-gram in the part of its prefix that leaves
    enough for a partner of its own size, which is shorter; so smaller entries are taken from there only. Joined are
    n-gram, band of sizes (a partner is in the smaller one's band or the next) and, where an n-gram has many rows, a salt.
    Rows of the leader's component lc are joined with others only, never among themselves. Pairs that share a passage and
    little else, of which there may be very many, end at a suffix filter inside the join (texts under some 700 n-grams do).
    """
    band = F.floor(F.log("n") / math.log(102 / share))
    salts = F.ceil(F.col("group") / SALTED).cast("int")
    larger = placed.select(
        "gram", band.alias("band"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"),
        F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("c").alias("oc"), (F.col("c") == F.col("lc")).alias("in_lead"),
        *[F.col(b).alias(f"other_{b}") for b in BRIEFS],
    )
    smaller = placed.where(F.col("n") - F.col("place") >= _needed(F.col("n"), F.col("n"), share))
    smaller = smaller.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    agree = _briefs_agree(F.col("n") + F.col("m") - 2 * _needed(F.col("n"), F.col("m"), share))
    ordered = F.struct("n", "id") < F.struct(F.col("m").alias("n"), F.col("other").alias("id"))
    found = []
    for inside in (False, True):
        left = smaller.where((F.col("c") == F.col("lc")) == inside)
        right = larger.where(~F.col("in_lead")) if inside else larger
        pairs = left.join(right, ["gram", "band", "salt"]).where((F.col("c") != F.col("oc")) & ordered & _may_link(share) & agree)
        found.append(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")))
    return found[0].unionByName(found[1])


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """One row per row of df: key, `n_shingles` long, `component_id`: the smallest key reachable by links.

    Rows link when 100 * intersection >= share * union of their sets of distinct `words`-word shingles (A-Z lower-cased;
    with fewer words, all of them as one). A row without words (null, empty) is linked with nothing. Very long texts count
    whole. Rows of a null or repeated key are rows of their own, nulls last; an empty table gives an empty one.

    Rows with equal sets are classes, made by their digests; one of each goes on. n-grams are ordered rarest first, by
    counts over all documents, and rows are joined on their prefixes' n-grams: first each with one leader per n-gram, the
    row that has the fewest rarer n-grams of its own and so is the most central one, which ties tight groups together in a
    number of pairs that is linear in the group; then rows in different components still, as _other_pairs says. No pair
    that can link is left out, none is verified twice, and a group whose rows are tied is not expanded into its pairs.
    """
    with small_batches(df.sparkSession):
        return _components(df, key, text, words, share)


def _components(df: DataFrame, key: str, text: str, words: int, share: int) -> DataFrame:
    """The rows of similar_components; what is left to run then is joins of written tables, without Python."""
    docs, names = with_ids(df, key, text)
    scratch = Scratch(df.sparkSession, "jaccard")
    bits = min(24, max(4, (4 * partitions(df.sparkSession) - 1).bit_length()))
    survey = scratch.write("survey", _survey(docs, words, bits))
    info = scratch.write("info", survey.where("bucket < 0").drop("bucket", "grams"))
    frequent = _frequent(survey.where("bucket >= 0").select("bucket", "grams"), scratch)
    scratch.empty("survey", "counts")
    classes = scratch.write("classes", info.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id"))

    prefixes = scratch.write("prefixes", _prefixes(docs, words, share, frequent, bits))
    often = prefixes.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    index = scratch.write("index", prefixes.join(often, "gram", "left_semi").join(reps, "id", "left_semi"))
    scratch.empty("prefixes")

    first = F.min(F.struct(F.col("place").alias("at"), F.xxhash64("id").alias("h"), F.col("id").alias("leader"), F.col("n").alias("m"))).alias("x")
    leaders = index.groupBy("gram").agg(first, F.count("*").alias("group")).where("group > 1").select("gram", "x.leader", "x.m", "x.at", "group")
    leaders = scratch.write("leaders", leaders)
    stars = index.join(leaders, "gram").where((F.col("id") != F.col("leader")) & _may_link(share))
    stars = scratch.write("stars", stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    links = _linked("links", stars, info, docs, words, share, scratch)

    tied = components(links)
    label = lambda c: tied.select(F.col("v").alias(c), F.col("component").alias(f"{c}_in"))
    placed = index.join(leaders.select("gram", "leader", "group"), "gram").join(label("id"), "id", "left").join(label("leader"), "leader", "left")
    placed = placed.select("gram", "id", "n", "place", "group", F.coalesce("id_in", "id").alias("c"), F.coalesce("leader_in", "leader").alias("lc"))
    placed = scratch.write("placed", placed)
    # n-grams whose rows the leaders have tied together give no further pair
    open_grams = placed.where("c != lc").select("gram").distinct()
    entries = placed.join(open_grams, "gram", "left_semi").join(info.select("id", *BRIEFS), "id")
    entries = scratch.write("entries", entries)
    scratch.empty("placed")
    rest = _other_pairs(entries, share).distinct().join(stars, ["a", "b"], "left_anti")
    more = _linked("more", rest, info, docs, words, share, scratch)
    scratch.empty("entries", "index", "leaders", "stars")
    final = components(links.unionByName(more)) if not more.isEmpty() else tied

    classes = classes.join(final, classes["rep"] == final["v"], "left").select("digest", F.coalesce("component", "rep").alias("class"))
    # rows without words, which may be very many, share a digest but no class
    out = info.where("n > 0").join(classes, "digest").select("id", F.col("n").alias("n_shingles"), F.col("class").alias("component"))
    out = out.unionByName(info.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))
    if names is None:
        return out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"))
    smallest = names.select(F.col("id").alias("component"), F.col("key").alias("component_id"))
    return out.join(names, "id").join(smallest, "component").select(F.col("key").alias(key), "n_shingles", "component_id")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), words=4, share=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT doc_id AS v, doc_id AS m FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(m) AS m FROM r GROUP BY v) c ON c.v = d.doc_id
"""
