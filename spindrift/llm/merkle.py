"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, number_rows
from .common import table
from .sharding import _crc32_sql

#: Nodes that become one, and levels that one block of leaves collapses: a block has FANOUT ** LEVELS nodes at most.
FANOUT, LEVELS = 3, 6
#: Powers of FANOUT that fit a long.
POWERS = [FANOUT**k for k in range(39)]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Column) -> Column:
    """H: lowercase hex sha256 of a text, digests in it being hex themselves."""
    return F.sha2(parts.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(v) for v in values]))


def _height(n: Column) -> Column:
    """Levels until n nodes are one."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def _above(nodes: Column) -> Column:
    """The level above: every FANOUT consecutive digests, the last run maybe fewer, become theirs."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * FANOUT + 1, FANOUT), "")))


def _collapse(nodes: Column, depth: Column) -> Column:
    """All levels of a block from its nodes up, `depth` of them above."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= depth)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1)))))


def _path(levels: Column, place: Column) -> Column:
    """What stands beside a node on its way up a block, level by level: `left` and `right` of it in its run, joined."""

    def beside(k: Column) -> Column:
        level = F.element_at(levels, k)
        at = F.floor(place / F.element_at(F.array(*[F.lit(p) for p in POWERS[: LEVELS + 1]]), k)).cast("int")
        own = at % FANOUT
        left = F.array_join(F.slice(level, at - own + 1, own), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(level, at + 2, F.lit(FANOUT - 1) - own), "").alias("right"))

    below = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k < F.size(levels))
    return F.transform(below, beside)


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its way lead to."""
    return F.aggregate(path, leaf_digest, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


_NO_PATH = "array<struct<left:string,right:string>>"


def _blocks(nodes: DataFrame, rounds: int) -> list[DataFrame]:
    """The blocks of each round. nodes: `g` (group), `n` (nodes of the group), `pos` (place in it), `node` (digest), `row`.

    A round collapses LEVELS levels of each group that still has more than one node; what a block leaves is a node of the
    next round. Blocks are arrays of bounded size, made by (group, block), so a large group is many of them."""
    found = []
    width = FANOUT**LEVELS
    for r in range(rounds):
        depth = F.greatest(F.lit(0), F.least(F.lit(LEVELS), _height(F.col("n")) - r * LEVELS))
        grouped = nodes.groupBy("g", "n", F.floor(F.col("pos") / width).alias("b"))
        block = grouped.agg(F.sort_array(F.collect_list(F.struct(F.pmod("pos", F.lit(width)).cast("int").alias("at"), "node", "row"))).alias("nodes"))
        levels = _collapse(F.transform("nodes", lambda x: x["node"]), depth)
        found.append(materialise(block.select("g", "n", "b", "nodes", levels.alias("levels")), "merkle-blocks"))
        nodes = found[-1].select("g", "n", F.col("b").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"), F.lit(None).cast("int").alias("row"))
    return found


def _paths(blocks: list[DataFrame], above: DataFrame, extra: list[str]) -> DataFrame:
    """From above (`g`, `b`, `up`, extra: of what each group's last node meets further up) down to the first round's
    rows: `g`, `pos`, `node`, `row`, `path`, extra."""
    for found in reversed(blocks):
        each = found.join(above, ["g", "b"]).select("g", "b", "up", *extra, "levels", F.explode("nodes").alias("x"))
        path = F.concat(_path(F.col("levels"), F.col("x.at")), F.col("up"))
        pos = (F.col("b") * FANOUT**LEVELS + F.col("x.at")).alias("pos")
        rows = each.select("g", pos, F.col("x.node").alias("node"), F.col("x.row").alias("row"), path.alias("path"), *extra)
        above = rows.select("g", F.col("pos").alias("b"), F.col("path").alias("up"), *extra)
    return rows


def _rounds(height: int) -> int:
    return max(1, -(-height // LEVELS))


def manifest(df: DataFrame, key: str, source: str, leaves: Column, tampered: Column) -> DataFrame:
    """A row per row: key, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified`.

    Per source, leaves stand by key, nulls first; repeated keys by leaf, so that only rows equal in both may swap places.
    Sources stand by code point, null first. `leaves` and `tampered` are digests: what a row is, and what is checked
    against the root with the siblings of the true tree. A null text is a value of its own, an empty one another; very
    long texts are digested whole and travel no further. An empty table gives an empty manifest. Columns of df that
    aren't named play no part and clash with nothing.

    Places come from range partitions and their counts, so a source of any size is many tasks. Blocks of FANOUT ** LEVELS
    consecutive leaves collapse in one array each by higher-order functions; block roots are the next round's nodes.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), leaves.alias("leaf"), tampered.alias("tampered"))
    rows = materialise(rows, "merkle-leaves")
    order = [F.asc_nulls_first("s"), F.asc_nulls_first("k"), F.asc("leaf")]
    placed = materialise(number_rows(rows, *order, name="place"), "merkle-placed")
    # a source begins at its smallest place: that numbers it, and says where each leaf stands in it
    sources = materialise(placed.groupBy("s").agg(F.min("place").alias("g"), F.count("*").alias("n")), "merkle-sources")
    nodes = _within_sources(placed, sources)
    most = sources.agg(F.max(_height(F.col("n"))).alias("most"), F.count("*").alias("sources"), _height(F.count("*")).alias("top")).first()
    blocks = _blocks(nodes, _rounds(most["most"] or 0))
    last = blocks[-1].select("g", F.element_at(F.element_at("levels", -1), 1).alias("subroot"))
    tops = number_rows(last, "g").select(F.lit(0).alias("g"), F.lit(most["sources"]).cast("long").alias("n"), "pos", F.col("subroot").alias("node"), F.col("g").alias("row"))
    upper = _blocks(tops, _rounds(most["top"] or 0))
    root = F.element_at(F.element_at("levels", -1), 1)
    above = upper[-1].select("g", F.lit(0).cast("long").alias("b"), F.array().cast(_NO_PATH).alias("up"), root.alias("root"))
    heads = _paths(upper, above, ["root"])
    heads = heads.select(F.col("row").alias("g"), F.lit(0).cast("long").alias("b"), F.col("path").alias("up"), F.col("node").alias("subroot"), "root")
    found = _paths(blocks, heads, ["subroot", "root"])
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    found = found.select(
        F.col("row.k").alias("key"), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
        fold(F.col("row.tampered"), F.col("path")).alias("folded_root"),
    )
    return found.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _within_sources(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """The leaves as nodes of their source. Many rows share a source, so the join is on slices of places too: a source
    has a row for each slice that it reaches into."""
    slices = 1 << 12
    reach = F.sequence(F.floor(F.col("g") / slices), F.floor((F.col("g") + F.col("n") - 1) / slices))
    spread = sources.select("s", "g", "n", F.explode(reach).alias("slice"))
    sliced = placed.withColumn("slice", F.floor(F.col("place") / slices))
    both = sliced.alias("p").join(spread.alias("q"), (F.col("p.slice") == F.col("q.slice")) & F.col("p.s").eqNullSafe(F.col("q.s")))
    return both.select("q.g", "q.n", (F.col("p.place") - F.col("q.g")).alias("pos"), F.col("p.leaf").alias("node"), F.struct("p.k", "p.tampered").alias("row"))


def document_leaves(text: Callable[[Column], Column] = lambda t: t) -> Column:
    return leaf([text(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents; where the key's CRC-32 is even, the checked leaf is of the text without its line ends."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, document_leaves(lambda t: F.translate(t, "\n", ""))).otherwise(document_leaves())
    return manifest(docs, "doc_id", "source", document_leaves(), tampered)


def _encoded_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(text if c == "text" else c) for c in FIELDS) + ")"


#: Every level of every tree, and every leaf's way through them; group 1 of `trees` is the tree of the sources.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS tampered
  FROM documents),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM ranked
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY g, level, pos // 3),
subroots AS (SELECT g, h AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS pos, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, pos // 3),
lowruns AS (SELECT g, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL),
highruns AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM high WHERE n > 1 GROUP BY ALL),
tall AS (SELECT g, max(level) AS top FROM low GROUP BY g),
way AS (
  SELECT g, pos AS leafpos, pos AS at, 0 AS step, tampered AS acc, '' AS siblings, false AS up FROM ranked
  UNION ALL
  SELECT w.g, leafpos, p // 3, step + 1,
         sha256(array_to_string(hs[1 : p % 3], '') || acc || array_to_string(hs[p % 3 + 2 : 3], '')),
         siblings || array_to_string(hs[1 : p % 3], '') || array_to_string(hs[p % 3 + 2 : 3], ''), is_high
  FROM (
    SELECT w.*, l.hs, w.at AS p, false AS is_high FROM way w JOIN lowruns l ON l.g = w.g AND l.level = w.step AND l.run = w.at // 3 JOIN tall t ON t.g = w.g WHERE w.step < t.top
    UNION ALL
    SELECT w.*, r.hs, CASE WHEN w.step = t.top THEN w.g ELSE w.at END AS p, true
    FROM way w JOIN tall t ON t.g = w.g JOIN highruns r ON r.level = w.step - t.top AND r.run = (CASE WHEN w.step = t.top THEN w.g ELSE w.at END) // 3 WHERE w.step >= t.top
  ) w),
ends AS (SELECT g, leafpos, arg_max(acc, step) AS folded_root, arg_max(siblings, step) AS siblings FROM way GROUP BY g, leafpos)
SELECT r.doc_id, r.leaf, s.subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(e.siblings) AS proof_sha256, e.folded_root,
       e.folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM ranked r JOIN ends e ON e.g = r.g AND e.leafpos = r.pos JOIN subroots s ON s.g = r.g
"""
