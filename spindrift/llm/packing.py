"""Packing token sequences: cutting stock by column generation over the histogram of lengths."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

CAPACITY = 1024
END = 0
#: What cutting a document costs, as a share of what it fills: patterns that waste less are preferred to cuts.
CUT_PENALTY = 1 / 256
#: The linear program ends when no pattern saves more than this share, or after so many columns.
TOLERANCE, MOST_COLUMNS = 2e-4, 1500
#: The same vocabulary as ranks, and as the file that says what tokens were added to it.
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@lru_cache(2)
def _tokenizer(ranks_path: str | None, path: str | None):
    """The vocabulary's encoder; its ids are those that the same vocabulary gives in `tokenizers`, added tokens included."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        added = {t["content"]: int(t["id"]) for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(1)
def _patient_tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


def token_ids(text: str, ranks: str | None = None, vocabulary: str | None = None) -> list[int]:
    """The ids of a whole text. The quick encoder refuses runs of white space of about a million characters, for which
    its pattern would look back too far; such a text goes to the slower one, which gives the same ids."""
    try:
        return _tokenizer(ranks, vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return _patient_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


def tokenised(df: DataFrame, key: str, text: str, ranks: str | None = None, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per row: `uid`, key, `tokens` long (with the closing id), `crcs` of its full pieces of `capacity`,
    `rest` int and `tail` binary (the ids after them, unsigned little-endian). A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _tokenizer(ranks, vocabulary)
        kind = "<u2" if encoder.n_vocab <= 1 << 16 else "<u4"
        for batch in batches:
            rows = []
            for uid, k, t in zip(batch["uid"], batch["_key"], batch["_text"], strict=True):
                ids = np.asarray([*token_ids(t or "", ranks, vocabulary), END], "<u4")
                cut = len(ids) // capacity * capacity
                crcs = [zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, cut, capacity)]
                rows.append((uid, k, len(ids), crcs, len(ids) - cut, ids[cut:].astype(kind).tobytes()))
            yield pd.DataFrame(rows, columns=["uid", "_key", "tokens", "crcs", "rest", "tail"]).astype({"_key": batch["_key"].dtype})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"uid long, _key {kind}, tokens long, crcs array<long>, rest int, tail binary")


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded, by dynamic programming: for each capacity the best sum of values and the length it takes last (0:
    none). value[l] is that of a piece of length l."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        sums = value[1 : c + 1] + best[c - 1 :: -1][:c]
        took[c] = sums.argmax() + 1
        best[c] = sums[took[c] - 1]
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], 0
    return best, took


def _pattern(took: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The counts of the best pattern that holds a piece of length `first`."""
    counts, c = {first: 1}, capacity - first
    while c > 0:
        if took[c]:
            counts[int(took[c])] = counts.get(int(took[c]), 0) + 1
        c -= took[c] or 1
    return counts


def column_generation(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, fractional, covering the demand for each length with the fewest sequences.

    Revised simplex. Cutting a piece of length l costs l / capacity and a penalty; the first basis pairs lengths that
    fill a sequence and cuts what is over. The knapsack, solved once for all capacities, prices new patterns by the
    dual values; the best ones around several lengths enter. The program's size is that of the histogram: under
    `capacity` rows. It may stop early: any basis covers the demand.
    """
    lengths = np.array(sorted(l for l, d in demand.items() if d > 0), int)
    m = len(lengths)
    if not m:
        return []
    row = {int(l): i for i, l in enumerate(lengths)}
    cut = lengths / capacity * (1 + CUT_PENALTY)
    inverse, used = np.eye(m), np.array([float(demand[int(l)]) for l in lengths])
    cost, basis, dual = cut.copy(), [None] * m, cut.copy()
    least = float((lengths * used).sum()) / capacity

    def enter(column: np.ndarray, price: float, pattern: dict[int, int] | None) -> None:
        at = np.flatnonzero(column)
        step = inverse[:, at] @ column[at]
        rows = np.flatnonzero(np.abs(step) > 1e-12)
        can = rows[step[rows] > 1e-9]
        if not len(can):
            return
        out = int(can[(used[can] / step[can]).argmin()])
        move = used[out] / step[out]
        used[rows] = np.maximum(used[rows] - move * step[rows], 0)
        used[out] = move
        saved = price - float(dual[at] @ column[at])
        inverse[out] /= step[out]
        some = np.flatnonzero(inverse[out])
        others = rows[rows != out]
        inverse[np.ix_(others, some)] -= np.outer(step[others], inverse[out, some])
        dual[some] += saved * inverse[out, some]
        cost[out], basis[out] = price, pattern

    def try_pattern(pattern: dict[int, int], gain: float) -> bool:
        column = np.zeros(m)
        for l, n in pattern.items():
            column[row[l]] = n
        if float(dual @ column) <= 1 + gain:
            return False
        enter(column, 1.0, pattern)
        return True

    for l in map(int, lengths[2 * lengths >= capacity]):
        if capacity - l in row:
            try_pattern({l: 1, capacity - l: 1} if 2 * l != capacity else {l: 2}, 0)
    entered = 0
    while entered < MOST_COLUMNS and float(cost @ used) > least * (1 + TOLERANCE):
        for k in np.flatnonzero(dual > cut + TOLERANCE):
            enter(np.eye(1, m, k)[0], cut[k], None)
            entered += 1
        value = np.zeros(capacity + 1)
        value[lengths] = np.maximum(dual, 0)
        best, took = knapsack(value, capacity)
        gains = dual + best[capacity - lengths]
        order = np.argsort(-gains, kind="stable")[:24]
        new = sum(try_pattern(_pattern(took, int(lengths[k]), capacity), TOLERANCE) for k in order if gains[k] > 1 + TOLERANCE)
        entered += new
        if not new:
            break
    return [(b, float(x)) for b, x in zip(basis, used, strict=True) if b is not None and x > 1e-9]


@dataclass
class Plan:
    """Where each ranked document of each length goes. By length: first ranks of its runs, and of each run its first
    sequence, copies in a sequence and first offset; after the last run the stream of pieces that are cut."""

    capacity: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    cut_from: dict[int, int] = field(default_factory=dict)
    cut_at: dict[int, int] = field(default_factory=dict)
    sequences: int = 0  # by patterns
    stream: int = 0  # tokens that are cut

    @cached_property
    def _firsts(self) -> dict[int, list[int]]:
        return {l: [r[0] for r in runs] for l, runs in self.runs.items()}

    @cached_property
    def _ends(self) -> list[int]:
        """Ends of the sequences after the stream's last full one: powers of two, which need no padding. Read once the
        stream is complete."""
        at, ends = self.stream // self.capacity * self.capacity, []
        while at < self.stream:
            at += 1 << ((self.stream - at).bit_length() - 1)
            ends.append(at)
        return ends

    @property
    def all_sequences(self) -> int:
        return self.sequences + self.stream // self.capacity + len(self._ends)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces of one document's rest: start, length, sequence, offset."""
        if rank < self.cut_from[length]:
            first, sequence, copies, offset = self.runs[length][bisect_right(self._firsts[length], rank) - 1]
            k = rank - first
            return [(0, length, sequence + k // copies, offset + k % copies * length)]
        at, end, out = self.cut_at[length] + (rank - self.cut_from[length]) * length, 0, []
        begin, full = at, self.stream // self.capacity
        while at < begin + length:
            if at < full * self.capacity:
                sequence, low, end = at // self.capacity, at // self.capacity * self.capacity, (at // self.capacity + 1) * self.capacity
            else:
                ends = [full * self.capacity, *self._ends]
                k = bisect_right(ends, at)
                sequence, low, end = full + k - 1, ends[k - 1], ends[k]
            end = min(end, begin + length)
            out.append((at - begin, end - at, self.sequences + sequence, at - low))
            at = end
        return out


def plan_packing(demand: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Round the linear program's patterns to whole sequences: down first, then once more where documents are left,
    the largest fractions first. What no pattern takes is cut."""
    plan, left = Plan(capacity), {l: int(d) for l, d in demand.items() if d > 0}
    solved = column_generation(left, capacity)
    whole: dict[int, int] = {}
    for k, (pattern, x) in enumerate(solved):
        whole[k] = max(0, min(int(x + 1e-7), *(left[l] // n for l, n in pattern.items())))
        for l, n in pattern.items():
            left[l] -= n * whole[k]
    for k in sorted(whole, key=lambda k: solved[k][1] % 1, reverse=True):
        if solved[k][1] % 1 > 1e-7 and all(left[l] >= n for l, n in solved[k][0].items()):
            whole[k] += 1
            for l, n in solved[k][0].items():
                left[l] -= n
    taken = dict.fromkeys(left, 0)
    for k, (pattern, _x) in enumerate(solved):
        if whole[k]:
            offset = 0
            for l, n in sorted(pattern.items(), reverse=True):
                plan.runs.setdefault(l, []).append((taken[l], plan.sequences, n, offset))
                taken[l] += n * whole[k]
                offset += n * l
            plan.sequences += whole[k]
    for l in sorted(left, reverse=True):
        plan.cut_from[l], plan.cut_at[l] = taken[l], plan.stream
        plan.stream += left[l] * l
    return plan


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: key, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (all long).

    Full pieces of `capacity` ids are sequences of their own; the rests, of at most capacity - 1 ids, fill patterns.
    Each row counts, repeated ones too; a null or empty text is its closing id alone, a very long one has as many pieces
    as it needs. A string of an added token in a text is that token. An empty table gives no piece.
    The driver sees the histogram of lengths only. Documents of a length are ranked by key in slices, each with its
    first rank from the counts of the slices before, so that a length that very many documents share is spread.
    """
    spark = df.sparkSession
    rows = materialise(tokenised(df, key, text, ranks, vocabulary, capacity), "packing-ids")
    slices = 4 * partitions(spark)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("uid"), F.lit(slices)))
    counts = materialise(rows.groupBy("rest", "_slice").agg(F.count("*").alias("_n")), "packing-lengths")
    demand = {r["rest"]: int(r["n"]) for r in counts.groupBy("rest").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_packing({l: n for l, n in demand.items() if l}, capacity)
    before, total = {}, 0
    for l in sorted(demand):
        before[l], total = total, total + demand[l]
    earlier = Window.partitionBy("rest").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("rest", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("rest", "_slice").orderBy("_key", "uid")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["rest", "_slice"])
    ranked = ranked.select("_key", "tokens", "crcs", "rest", "tail", (F.col("_rank") + F.col("_first")).alias("rank"))
    shared = spark.sparkContext.broadcast((plan, before, total))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, before, total = shared.value
        for batch in batches:
            out = []
            for k, tokens, crcs, rest, tail, rank in zip(batch["_key"], batch["tokens"], batch["crcs"], batch["rest"], batch["tail"], batch["rank"], strict=True):
                number, cut = before[rest] + rank, tokens - rest
                out += [(k, capacity * i, capacity, int(c), tokens, plan.all_sequences + number + i * total, 0) for i, c in enumerate(crcs)]
                if rest:
                    ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * rest else "<u4").astype("<u4")
                    out += [(k, cut + a, n, zlib.crc32(ids[a : a + n].tobytes()), tokens, s, o) for a, n, s, o in plan.place(rest, rank)]
            yield pd.DataFrame(out, columns=["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"_key": batch["_key"].dtype})

    kind = df.schema[key].dataType.simpleString()
    pieces = ranked.mapInPandas(place, f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("_key", key)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
