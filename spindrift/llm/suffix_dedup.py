"""Removal of repeated byte strings: suffix arrays over content shards, merged across shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import materialise, table, with_ids
from .suffix_array import shares_with_previous, suffix_array

WINDOW = 100
#: Bytes of a shard's text that one suffix array covers, about, and contexts of one anchor in one shard, about.
SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 2000
#: Rows, and bytes in them, that a task hands on at once.
ROWS, BYTES = 1 << 18, 1 << 22

#: Windows in the order of their bytes, and of each its document and start.
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashes(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for t in batch["text"]:
                for h, _low, _high in anchors(_bytes(t), window):
                    held.append(h)
                    size += len(h)
                if size >= ROWS:
                    yield pd.DataFrame({"anchor": np.concatenate(held)})
                    held, size = [], 0
        if size:
            yield pd.DataFrame({"anchor": np.concatenate(held)})

    return docs.select("text").mapInPandas(run, "anchor long")


def _places(docs: DataFrame, window: int) -> DataFrame:
    """A row for each place of an anchor: the windows that it stands for start at `low` to `high`; `one` and `two` are a
    digest of 128 bits of all their bytes, the place's context."""
    columns = ["anchor", "id", "low", "high"]

    def frame(held: list[tuple]) -> pd.DataFrame:
        made = {c: np.concatenate([x[n] for x in held]) for n, c in enumerate(columns)}
        digest = np.frombuffer(b"".join(x[4] for x in held), "<i8").reshape(-1, 2)
        return pd.DataFrame(made | {"one": digest[:, 0], "two": digest[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, named = [], 0, xxhash.xxh3_128_digest
        for batch in batches:
            for k, t in zip(batch["id"], batch["text"], strict=True):
                body = _bytes(t)
                for h, low, high in anchors(body, window):
                    digests = b"".join([named(body[a:b]) for a, b in zip(low.tolist(), (high + window).tolist(), strict=True)])
                    held.append((h, np.full(len(h), k), low, high, digests))
                    size += len(h)
                if size >= ROWS:
                    yield frame(held)
                    held, size = [], 0
        if size:
            yield frame(held)

    return docs.mapInPandas(run, "anchor long, id long, low long, high long, one long, two long")


def _with_bytes(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The places wanted (anchor, shard, shards, id, low, high) with `data`, the bytes of their windows. Places go to the
    texts by id; one document's are about as long as its text."""
    columns = ["anchor", "shard", "shards", "low", "high"]
    by_id = wanted.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("p"))
    by_id = by_id.select("id", *[F.col("p")[c].alias(c) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for k, t, *found in zip(batch["id"], batch["text"], *(batch[c] for c in columns), strict=True):
                body = _bytes(t)
                for anchor, shard, shards, low, high in zip(*(x.tolist() for x in found), strict=True):
                    held.append((anchor, shard, shards, k, low, high, body[low : high + window]))
                    size += high + window - low
                    if size >= BYTES:
                        yield pd.DataFrame(held, columns=["anchor", "shard", "shards", "id", "low", "high", "data"])
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["anchor", "shard", "shards", "id", "low", "high", "data"])

    return docs.join(by_id, "id").mapInPandas(run, "anchor long, shard long, shards long, id long, low long, high long, data binary")


def _runs(ids: np.ndarray, starts: np.ndarray, window: int) -> pd.DataFrame:
    """Spans of bytes that windows at these starts cover, one for each run of neighbouring starts."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(ids) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(ids) else first
    return pd.DataFrame({"id": ids[first], "begin": starts[first], "end": starts[last] + window})


def _search(rows: list[tuple], window: int) -> Iterator[pd.DataFrame]:
    """Of the windows of some contexts (anchor, shard, shards, id, low, high, data): spans that an earlier window equals,
    by a suffix array and common prefixes; and, for anchors with several shards, the earliest window of each class."""
    body = b"".join(r[6] for r in rows)
    text = np.frombuffer(body, np.uint8)
    count = np.array([r[5] - r[4] + 1 for r in rows])
    begin = np.cumsum([0] + [len(r[6]) for r in rows[:-1]])
    of = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[of] + step
    order = suffix_array(text, window)
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(~shares_with_previous(text, order, window))
    ids, starts, kind = np.array([r[3] for r in rows])[of], np.array([r[4] for r in rows])[of] + step, number[place]
    by = np.lexsort((starts, ids, kind))
    earliest = np.zeros(len(of), bool)
    earliest[by] = np.concatenate([[True], kind[by][1:] != kind[by][:-1]])
    yield _runs(ids[~earliest], starts[~earliest], window)
    several = np.flatnonzero(earliest & (np.array([r[2] for r in rows])[of] > 1))
    for some in np.split(several, range(BYTES // window, len(several), BYTES // window)):
        if len(some):
            data = [body[p : p + window] for p in place[some].tolist()]
            of_some = [rows[k] for k in of[some].tolist()]
            part = [xxhash.xxh3_64_intdigest(x) % r[2] for x, r in zip(data, of_some, strict=True)]
            yield pd.DataFrame({"id": ids[some], "begin": starts[some], "anchor": [r[0] for r in of_some], "part": part, "run": [r[1] for r in of_some], "data": data})


def _search_shards(shards: DataFrame, window: int) -> DataFrame:
    """What _search finds in each shard; small shards share a suffix array. Rows without data are spans."""
    columns = ["anchor", "shard", "shards", "id", "low", "high", "data"]
    schema = "id long, begin long, end long, anchor long, part long, run long, data binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def solve(held: list[tuple]) -> Iterator[pd.DataFrame]:
        for found in _search(held, window):
            yield found.reindex(columns=names).astype({c: "Int64" for c in names[:-1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c] for c in columns), strict=True):
                if group and row[:2] != group[0][:2]:
                    held += group
                    size += sum(len(r[6]) for r in group)
                    group = []
                    if size >= SHARD_BYTES:
                        yield from solve(held)
                        held, size = [], 0
                group.append(row)
        if held or group:
            yield from solve(held + group)

    dealt = shards.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return dealt.select(*columns).mapInPandas(run, schema)


def _merge(a: Run, b: Run) -> tuple[Run, tuple[np.ndarray, np.ndarray]]:
    """Two runs as one, each window of the one sought in the other by binary search and compared in full; and, of the
    windows that both hold, the ids and starts of the later ones."""
    at = np.searchsorted(a[0], b[0])
    same = np.zeros(len(at), bool)
    inside = at < len(a[0])
    same[inside] = a[0][at[inside]] == b[0][inside]
    ids, starts = a[1].copy(), a[2].copy()
    here, there = at[same], np.flatnonzero(same)
    earlier = (b[1][there] < ids[here]) | ((b[1][there] == ids[here]) & (b[2][there] < starts[here]))
    late = np.where(earlier, ids[here], b[1][there]), np.where(earlier, starts[here], b[2][there])
    ids[here], starts[here] = np.where(earlier, b[1][there], ids[here]), np.where(earlier, b[2][there], starts[here])
    new = ~same
    return tuple(np.insert(x, at[new], y[new]) for x, y in ((a[0], b[0]), (ids, b[1]), (starts, b[2]))), late


def _merge_shards(classes: DataFrame, window: int) -> DataFrame:
    """Spans of windows that an earlier one in another shard of their anchor equals. classes: anchor, part (equal windows
    are in the same one), run (the shard), id, begin, data, a window's bytes. Runs merge with others of like size."""

    def merged(stack: list[Run], all_: bool) -> Iterator[pd.DataFrame]:
        while len(stack) > 1 and (all_ or len(stack[-2][0]) <= 2 * len(stack[-1][0])):
            b, a = stack.pop(), stack.pop()
            run, (ids, starts) = _merge(a, b)
            stack.append(run)
            yield pd.DataFrame({"id": ids, "begin": starts, "end": starts + window})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[Run] = []
        held: list[tuple] = []
        last = None

        def close() -> None:
            stack.append((np.array([r[0] for r in held], f"S{window}"), np.array([r[1] for r in held]), np.array([r[2] for r in held])))
            held.clear()

        for batch in batches:
            for anchor, part, nth, *row in zip(*(batch[c] for c in ("anchor", "part", "run", "data", "id", "begin")), strict=True):
                if last is not None and last != (anchor, part, nth):
                    close()
                    yield from merged(stack, last[:2] != (anchor, part))
                    if last[:2] != (anchor, part):
                        stack.clear()
                last = (anchor, part, nth)
                held.append(row)
        if held:
            close()
            yield from merged(stack, True)

    # a run's windows come in the order of their bytes, as in its suffix array
    dealt = classes.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "run", "data")
    return dealt.select("anchor", "part", "run", "data", "id", "begin").mapInPandas(run, "id long, begin long, end long")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: id, text. Spans (id, begin, end; they may overlap) that cover just the bytes of windows that start earlier
    too, in a document with a smaller id or further left in the same one.

    Shards are by content: equal windows have equal anchors, so the contexts of an anchor make a shard, or several if they
    are many. Places with the same context enter it once; the others repeat it whole. Only an anchor with two different
    contexts needs their bytes, and has them read from the texts again.
    """
    often = _hashes(docs, window).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = materialise(_places(docs, window).join(materialise(often, "suffix-anchors"), "anchor", "left_semi"), "suffix-places")
    same = ["anchor", "one", "two"]
    contexts = places.groupBy(*same).agg(F.min(F.struct("id", "low", "high")).alias("f"), F.count("*").alias("n"))
    contexts = materialise(contexts.select(*same, "f.*", "n"), "suffix-contexts")
    copied = contexts.where("n > 1").select(*same, F.col("id").alias("first_id"), F.col("low").alias("first_low"))
    later = places.join(copied, same).where("id <> first_id OR low <> first_low")
    spans = later.select("id", F.col("low").alias("begin"), (F.col("high") + window).alias("end"))
    sizes = contexts.groupBy("anchor").agg(F.ceil(F.count("*") / SHARD_CONTEXTS).cast("long").alias("shards"), F.count("*").alias("m")).where("m > 1")
    unlike = contexts.join(sizes, "anchor").select("anchor", F.pmod("one", "shards").alias("shard"), "shards", "id", "low", "high")
    found = materialise(_search_shards(_with_bytes(docs, unlike, window), window), "suffix-shards")
    merged = _merge_shards(found.where("data IS NOT NULL"), window)
    return spans.unionByName(found.where("data IS NULL").select("id", "begin", "end")).unionByName(merged)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rest: bool = True) -> DataFrame:
    """One row per row of df: key, `n_bytes`, `n_removed`, `n_spans` long, `kept_sha256` string and, with `rest`, `kept`
    binary, the bytes that remain.

    Texts are UTF-8 bytes, null is empty; a text shorter than a window stays whole, a very long one is read in pieces. Rows
    of a null or repeated key are rows of their own, ordered by key (nulls last) and text; of equal rows the first stays.
    An empty table gives an empty one. The spans of a document, which are put together for it, take less than its text.
    """
    docs, names = with_ids(df, key, text)
    spans = repeated_spans(docs, window).groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    spans = spans.select("id", F.col("s")["begin"].alias("begin"), F.col("s")["end"].alias("end"))
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if rest else 5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, begin, end in zip(batch["id"], batch["text"], batch["begin"], batch["end"], strict=True):
                body, runs = _bytes(t), []
                if begin is not None:
                    for a, b in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                kept = b"".join(body[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(body)], strict=True))
                out.append((k, len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(columns)])
            yield pd.DataFrame(out, columns=columns)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * rest
    found = docs.join(spans, "id", "left").mapInPandas(run, schema)
    if names is None:
        return found.withColumnRenamed("id", key)
    return found.join(names, "id").select(F.col("key").alias(key), *columns[1:])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), rest=False)


# texts as hexadecimal digits, cut into blocks first, so that a window is cut from a short string
OP8_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
b AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 2198) AS x
  FROM (SELECT doc_id, h, unnest(range(0, n_bytes, 1000)) AS o FROM d)),
w AS (
  SELECT doc_id, o + t AS s, unhex(substr(x, 2 * t + 1, 200)) AS y
  FROM (SELECT doc_id, o, x, unnest(range(0, least(1000, length(x) // 2 - 99))) AS t FROM b)),
l AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY y ORDER BY doc_id, s) > 1),
f AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept,
         max(e) AS last, count(*) AS n_spans, sum(e - a) AS n_removed
  FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
