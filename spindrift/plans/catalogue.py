"""Named queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions import scalars as S
from ..operators import exchange as E
from ..operators import graph as G
from ..operators import linear_order as L
from ..operators import metrics, peel, spmm
from ..sources import csr, files, generators, graphs
from ..sources.level_store import LevelStore
from ..storage import materialise, number_rows, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the SQL below starts from.
PS = "ps AS (SELECT l_partkey AS i, (SELECT count(*) FROM part) + l_suppkey AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL), n AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n)"
CP = "cp AS (SELECT o_custkey AS i, (SELECT count(*) FROM customer) + l_partkey AS j, count(*)::DOUBLE AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
NT = "nt AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
US = "us AS (SELECT i, j, count(*)::DOUBLE AS v FROM (SELECT user_id AS i, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS j FROM events) WHERE j IS NOT NULL GROUP BY ALL)"
TT = "k AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c), tt AS (SELECT n_regionkey::BIGINT AS i, n_nationkey + r AS j FROM nation, k UNION ALL SELECT c_nationkey + r, c_custkey + r + n FROM customer, k UNION ALL SELECT o_custkey + r + n, o_orderkey + r + n + c FROM orders, k)"
SYM = "sy AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM ps UNION ALL SELECT j, i, v FROM ps WHERE i <> j) GROUP BY ALL)"
DEG = "dg AS (SELECT v, count(*) AS d FROM (SELECT i AS v FROM ps UNION ALL SELECT j FROM ps) GROUP BY v), ve AS (SELECT range AS v FROM range((SELECT n FROM n))), rk AS (SELECT v, coalesce(d, 0) AS d, row_number() OVER (ORDER BY coalesce(d, 0) DESC, v) - 1 AS rank FROM ve LEFT JOIN dg USING (v))"


def x_sql(features: int, n: str = "(SELECT n FROM n)") -> str:
    return f"x AS (SELECT a.range AS v, b.range::INT AS f, ((a.range * 7 + b.range * 3) % 11)::DOUBLE AS x FROM range({n}) a, range({features}) b)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Matrices of the tables


@query(f"WITH {PS} SELECT i, j, v FROM ps")
def edges_part_supplier(spark, d):
    return graphs.part_supplier(spark, d)[0]


@query(f"WITH {CP} SELECT i, j, v FROM cp")
def edges_customer_part(spark, d):
    return graphs.customer_part(spark, d)[0]


@query(f"WITH {NT} SELECT i, j, v FROM nt")
def edges_nation_trade(spark, d):
    return graphs.nation_trade(spark, d)[0]


@query(f"WITH {US} SELECT i, j, v FROM us")
def edges_user_steps(spark, d):
    return graphs.user_steps(spark, d)[0]


@query(f"WITH {TT} SELECT i, j, 1.0::DOUBLE AS v FROM tt")
def edges_trade_tree(spark, d):
    return graphs.trade_tree(spark, d)[0]


@query(f"WITH {PS}, {SYM} SELECT i, j, v FROM sy")
def adjacency_symmetric(spark, d):
    return M.symmetric(graphs.part_supplier(spark, d)[0])


@query(f"WITH {US} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM us UNION ALL SELECT j, i, v FROM us) GROUP BY ALL")
def symmetrised_sum(spark, d):
    return M.symmetrised(graphs.user_steps(spark, d)[0])


@query(f"WITH {US} SELECT least(i, j) AS i, greatest(i, j) AS j, sum(v) AS v FROM us GROUP BY ALL")
def undirected_pairs(spark, d):
    return M.undirected(graphs.user_steps(spark, d)[0])


@query(f"WITH {NT} SELECT j AS i, i AS j, v FROM nt")
def transpose(spark, d):
    return M.transpose(graphs.nation_trade(spark, d)[0])


@query(f"WITH {PS} SELECT i, j, v - 1 AS v FROM ps WHERE v - 1 <> 0")
def drop_zeros(spark, d):
    return M.drop_zeros(graphs.part_supplier(spark, d)[0].withColumn("v", F.col("v") - 1))


@query("SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity)::FLOAT AS v FROM lineitem GROUP BY ALL")
def cast_values(spark, d):
    items = graphs.table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    return M.cast_values(M.canonical(items), "float")


@query(f"WITH {PS} SELECT i, j, v FROM ps")
def zero_based_ids(spark, d):
    a = graphs.part_supplier(spark, d)[0]
    return M.zero_based(a.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"))


# Degrees, ranks, classes


@query(f"WITH {PS}, {DEG} SELECT v, d FROM dg")
def degree(spark, d):
    return M.degrees(graphs.part_supplier(spark, d)[0])


@query(f"WITH {PS} SELECT i, count(*) AS nnz FROM ps GROUP BY i")
def row_nnz(spark, d):
    return M.row_entries(graphs.part_supplier(spark, d)[0])


@query(f"WITH {PS} SELECT count(DISTINCT i) AS nonzero_rows, (SELECT n FROM n) - count(DISTINCT i) AS zero_rows FROM ps")
def zero_rows(spark, d):
    return M.row_summary(*graphs.part_supplier(spark, d))


@query(f"WITH {PS} SELECT DISTINCT j FROM ps")
def used_columns(spark, d):
    return M.used_columns(graphs.part_supplier(spark, d)[0])


@query(f"WITH {PS} SELECT count(*) AS nnz, count(DISTINCT i) AS rows, sum(v) AS total, bool_and(v > 0) AS all_positive, bool_or(v > 3) AS some_large FROM ps")
def matrix_totals(spark, d):
    a = graphs.part_supplier(spark, d)[0]
    return a.agg(F.count("*").alias("nnz"), F.countDistinct("i").alias("rows"), F.sum("v").alias("total"), F.bool_and(F.col("v") > 0).alias("all_positive"), F.bool_or(F.col("v") > 3).alias("some_large"))


def _ranked(spark, d, width):
    a, n = graphs.part_supplier(spark, d)
    return L.vertex_classes(a, spark.range(n).withColumnRenamed("id", "v"), width)


@query(f"WITH {PS}, {DEG} SELECT v, d FROM rk WHERE rank < 64")
def topw_head(spark, d):
    return _ranked(spark, d, 64).where("class = 'head'").select("v", "d")


@query(f"WITH {PS}, {DEG} SELECT v, CASE WHEN rank < 64 THEN 'head' WHEN d > 0 THEN 'middle' ELSE 'single' END AS class FROM rk")
def vertex_class(spark, d):
    return _ranked(spark, d, 64).select("v", "class")


@query(f"WITH {PS}, {DEG} SELECT v, rank AS pos FROM rk")
def degree_order_positions(spark, d):
    return _ranked(spark, d, 64).select("v", F.col("rank").alias("pos"))


@query(f"WITH {PS}, {DEG} SELECT rank AS pos, v, lag(v) OVER (ORDER BY rank) AS before FROM rk")
def inverse_positions(spark, d):
    r = materialise(_ranked(spark, d, 64).select(F.col("rank").alias("pos"), "v"), "ranked")
    return r.join(r.select((F.col("pos") + 1).alias("pos"), F.col("v").alias("before")), "pos", "left")


@query(f"WITH {PS}, {DEG}, p AS (SELECT d, lag(d) OVER (ORDER BY rank) AS b FROM rk) SELECT bool_and(coalesce(b >= d, true)) AS sorted FROM p")
def order_is_sorted(spark, d):
    r = materialise(_ranked(spark, d, 64).select("rank", "d"), "ranked")
    pairs = r.join(r.select((F.col("rank") + 1).alias("rank"), F.col("d").alias("b")), "rank", "left")
    return pairs.agg(F.bool_and(F.coalesce(F.col("b") >= F.col("d"), F.lit(True))).alias("sorted"))


# Split, width, tiles

_PLACED = f"{PS}, {DEG}, pl AS (SELECT p.rank AS pi, q.rank AS pj, i, j, a.v FROM ps a JOIN rk p ON p.v = a.i JOIN rk q ON q.v = a.j)"


def _placed(spark, d):
    a, n = graphs.part_supplier(spark, d)
    pos = materialise(_ranked(spark, d, 64).select("v", "rank"), "ranked")
    a = a.join(pos.select(F.col("v").alias("i"), F.col("rank").alias("pi")), "i").join(pos.select(F.col("v").alias("j"), F.col("rank").alias("pj")), "j")
    return a.select("pi", "pj", "i", "j", "v"), n


@query(f"WITH {_PLACED} SELECT i, j, abs(pi - pj) <= 200 OR pi < 200 OR pj < 200 AS kept FROM pl")
def band_split(spark, d):
    return _placed(spark, d)[0].select("i", "j", M.keeps(F.col("pi"), F.col("pj"), 200).alias("kept"))


@query(f"WITH {_PLACED} SELECT i, j, pi // 200 = pj // 200 OR pi < 200 OR pj < 200 AS kept FROM pl")
def block_split(spark, d):
    return _placed(spark, d)[0].select("i", "j", M.keeps(F.col("pi"), F.col("pj"), 200, block=True).alias("kept"))


@query(f"WITH {_PLACED} SELECT i, j, abs(pi - pj) <= 200 AS kept FROM pl")
def noprune_split(spark, d):
    return _placed(spark, d)[0].select("i", "j", M.keeps(F.col("pi"), F.col("pj"), 200, prune=False).alias("kept"))


@query(f"WITH {_PLACED} SELECT greatest(200, max(least(abs(pi - pj), pi + 1, pj + 1)))::BIGINT AS width FROM pl")
def width_actual(spark, d):
    return M.actual_width(_placed(spark, d)[0], 200, "pi", "pj")


@query(f"WITH {PS} SELECT i, j, v, i // 128 AS bi, j // 128 AS bj, i % 128 AS ri, j % 128 AS rj FROM ps")
def tile_coords(spark, d):
    return M.with_tiles(graphs.part_supplier(spark, d)[0], 128)


@query(f"WITH {PS} SELECT i // 128 AS bi, j // 128 AS bj, count(*) AS entries FROM ps GROUP BY ALL")
def tile_counts(spark, d):
    return M.with_tiles(graphs.part_supplier(spark, d)[0], 128).groupBy("bi", "bj").agg(F.count("*").alias("entries"))


@query(f"WITH {PS}, {SYM}, t AS (SELECT i, j, v, i // 128 AS bi, j // 128 AS bj FROM sy) SELECT i, j, v, bi, bj FROM t WHERE bi = 0 OR bj IN (0, bi - 1, bi, bi + 1)")
def structured_tiles(spark, d):
    tiles = M.with_tiles(M.symmetric(graphs.part_supplier(spark, d)[0]), 128)
    return M.structured_tiles(tiles).select("i", "j", "v", "bi", "bj")


@query(f"WITH {PS} SELECT i, j, v FROM ps WHERE i // 128 = 1 AND j // 128 = (SELECT n FROM n) // 128")
def one_tile(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return M.with_tiles(a, 128).where((F.col("bi") == 1) & (F.col("bj") == n // 128)).select("i", "j", "v")


@query(f"WITH {PS} SELECT ceil((max(greatest(i, j)) + 1) / 128)::BIGINT AS blocks FROM ps")
def block_count(spark, d):
    return M.block_count(graphs.part_supplier(spark, d)[0], 128)


@query(f"WITH {PS} SELECT i // 64 AS y, j // 64 AS x, count(*) AS entries FROM ps GROUP BY ALL")
def pattern_histogram(spark, d):
    return files.pattern_histogram(graphs.part_supplier(spark, d)[0], 64)


@query(f"WITH {NT} SELECT i, j, v, (SELECT count(*) FROM nation) AS rows, (SELECT count(*) FROM nation) AS columns FROM nt")
def matrix_market_round_trip(spark, d):
    a, n = graphs.nation_trade(spark, d)
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}.mtx"
    files.write_matrix_market(a, n, n, path)
    a, rows, columns = files.read_matrix_market(spark, path)
    return a.select("i", "j", "v", F.lit(rows).cast("long").alias("rows"), F.lit(columns).cast("long").alias("columns"))


@query(f"WITH {PS} SELECT i, j, v FROM ps")
def csr_round_trip(spark, d):
    path = f"{shared_dir(spark)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(graphs.part_supplier(spark, d)[0], path)
    return csr.read_csr(spark, path, 8)


@query(f"WITH {CP} SELECT i, j, v FROM cp WHERE i >= 20 AND i < 60")
def csr_row_slice(spark, d):
    path = f"{shared_dir(spark)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(graphs.customer_part(spark, d)[0], path)
    return csr.read_csr(spark, path, 8, rows=(20, 60))


# tiles by what the catalogue says of them, which is known at run time only
@query(f"WITH {PS}, t AS (SELECT i, j, v, i // 128 AS bi, j // 128 AS bj FROM ps) SELECT i, j, v, bi, bj FROM t WHERE (bi, bj) IN (SELECT (bi, bj) FROM t GROUP BY bi, bj HAVING count(*) BETWEEN 460 AND 1600)")
def catalogued_tiles(spark, d):
    path = f"{shared_dir(spark)}/catalogued-{uuid.uuid4().hex}"
    files.write_tile_catalogue(M.with_tiles(graphs.part_supplier(spark, d)[0], 128).select("i", "j", "v", "bi", "bj"), path)
    return files.read_catalogued(spark, path, "entries BETWEEN 460 AND 1600")


# Permutations and joins


@query(f"WITH {PS}, {DEG} SELECT p.rank AS i, q.rank AS j, a.v FROM ps a JOIN rk p ON p.v = a.i JOIN rk q ON q.v = a.j")
def relabel(spark, d):
    mapping = materialise(_ranked(spark, d, 64).select(F.col("v").alias("old"), F.col("rank").alias("new")), "ranked")
    a, n = graphs.part_supplier(spark, d)
    return M.relabel(a, mapping, n)


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS repeated, 0::BIGINT AS outside")
def mapping_is_bijection(spark, d):
    n = graphs.part_supplier(spark, d)[1]
    return M.bijection_errors(_ranked(spark, d, 64).select(F.col("v").alias("old"), F.col("rank").alias("new")), n)


@query(f"WITH {NT} SELECT (i * 7 + 3) % 25 AS i, (j * 7 + 3) % 25 AS j, v FROM nt")
def permute_graph(spark, d):
    a, n = graphs.nation_trade(spark, d)
    return M.relabel(a, spark.range(n).select(F.col("id").alias("old"), ((F.col("id") * 7 + 3) % 25).alias("new")), n)


@query(f"WITH {PS}, {DEG}, m AS (SELECT v FROM rk WHERE rank >= 64 AND d > 0) SELECT i, j, v FROM ps a WHERE i IN (SELECT v FROM m) AND j IN (SELECT v FROM m)")
def induced_subgraph(spark, d):
    middle = materialise(_ranked(spark, d, 64).where("class = 'middle'").select("v"), "middle")
    return M.induced(graphs.part_supplier(spark, d)[0], middle)


_TWO = f"{PS}, {DEG}, pe AS (SELECT 0 AS level, rank AS pos, v FROM rk UNION ALL SELECT 1, (SELECT n FROM n) - 1 - v, v FROM rk)"


def _two_levels(spark, d):
    n = graphs.part_supplier(spark, d)[1]
    a = _ranked(spark, d, 64).select(F.lit(0).alias("level"), F.col("rank").alias("pos"), "v")
    return materialise(a.unionByName(spark.range(n).select(F.lit(1).alias("level"), (F.lit(n) - 1 - F.col("id")).alias("pos"), F.col("id").alias("v"))), "perm"), n


@query(f'WITH {_TWO} SELECT a.pos, b.pos AS "to" FROM pe a JOIN pe b USING (v) WHERE a.level = 0 AND b.level = 1')
def perm_compose(spark, d):
    return E.moved_rows(_two_levels(spark, d)[0], 0, 1)


@query(
    f"WITH {_TWO}, q AS (SELECT ceil((SELECT n FROM n) / 8)::BIGINT AS r), m AS (SELECT a.pos, b.pos AS t, a.pos // r AS rank, b.pos // r AS peer FROM pe a JOIN pe b USING (v), q WHERE a.level = 0 AND b.level = 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY peer, pos) - 1 AS send_nth, row_number() OVER (PARTITION BY rank ORDER BY peer, t) - 1 AS receive_nth FROM m WHERE peer < 6), "
    "c AS (SELECT rank, peer, count(*) * 16 AS count FROM o GROUP BY ALL), e AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY rank ORDER BY peer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM c) "
    'SELECT rank, peer, pos, t AS "to", send_nth, receive_nth, count, displ FROM o JOIN e USING (rank, peer)'
)
def a2a_tables(spark, d):
    perm, n = _two_levels(spark, d)
    return E.all_to_all(E.moved_rows(perm, 0, 1), -(-n // 8), 6, 16)


# Components, forests, trees


@query(f"WITH RECURSIVE {TT}, e AS (SELECT i, j FROM tt UNION SELECT j, i FROM tt), w AS (SELECT i AS v, i AS c FROM tt WHERE i < (SELECT r FROM k) UNION SELECT e.j, w.c FROM w JOIN e ON e.i = w.v) SELECT v, min(c) AS component FROM w GROUP BY v")
def components(spark, d):
    a, n = graphs.trade_tree(spark, d)
    return G.all_components(a, spark.range(n).withColumnRenamed("id", "v"))


@query(f"WITH RECURSIVE {US}, e AS (SELECT DISTINCT i, j FROM us), w(v, l) USING KEY (v) AS (SELECT 0::BIGINT, 0 UNION SELECT DISTINCT e.j, w.l + 1 FROM w JOIN e ON e.i = w.v WHERE e.j NOT IN (SELECT v FROM recurring.w)), s AS (SELECT v, l::INT AS level FROM w) SELECT s.v, s.level, min(p.v) AS parent FROM s LEFT JOIN e ON e.j = s.v LEFT JOIN s p ON p.v = e.i AND p.level = s.level - 1 GROUP BY ALL")
def bfs_levels_directed(spark, d):
    a = graphs.user_steps(spark, d)[0]
    return G.bfs(a, spark.range(1).withColumnRenamed("id", "v"), directed=True)


@query(f"WITH RECURSIVE {TT}, w AS (SELECT range AS v, 0 AS level, NULL::BIGINT AS parent FROM range((SELECT count(*) FROM region)) UNION ALL SELECT j, level + 1, i FROM w JOIN tt ON i = v) SELECT v, level, parent FROM w")
def bfs_levels(spark, d):
    a, _ = graphs.trade_tree(spark, d)
    return G.bfs(a, spark.range(graphs.rows_of(spark, d, "region")).withColumnRenamed("id", "v"))


@query(f"WITH {TT} SELECT i, j, 1.0::DOUBLE AS w FROM tt")
def spanning_forest_of_tree(spark, d):
    a, _ = graphs.trade_tree(spark, d)
    return G.spanning_forest(a.withColumn("w", F.lit(1.0)))


# an edge is in the forest if no way between its ends has lighter edges only; lightest ways are made through one more vertex a step
@query(
    f"WITH RECURSIVE {US}, q AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM us WHERE i <> j), w AS (SELECT i, j, row_number() OVER (ORDER BY md5(i || ':' || j)) AS w FROM q), "
    "s AS (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w), v AS (SELECT i AS v, row_number() OVER (ORDER BY i) - 1 AS k FROM (SELECT DISTINCT i FROM s)), "
    "f AS (SELECT 0 AS k, a.v AS i, b.v AS j, coalesce(s.w, 1000000000000) AS w FROM v a CROSS JOIN v b LEFT JOIN s ON s.i = a.v AND s.j = b.v "
    "UNION ALL SELECT a.k + 1, a.i, a.j, least(a.w, greatest(b.w, c.w)) FROM f a JOIN v ON v.k = a.k JOIN f b ON b.i = a.i AND b.j = v.v JOIN f c ON c.i = v.v AND c.j = a.j) "
    "SELECT w.i, w.j FROM w JOIN f ON f.i = w.i AND f.j = w.j AND f.w = w.w WHERE f.k = (SELECT count(*) FROM v)"
)
def msf_edges(spark, d):
    a, _ = graphs.user_steps(spark, d)
    forest = G.spanning_forest(a.withColumn("w", F.md5(F.concat_ws(":", F.least("i", "j"), F.greatest("i", "j")))))
    return forest.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


_PREORDER = (
    f"WITH {TT}, o AS (SELECT o_custkey + r + n AS c, o_orderkey + r + n + (SELECT c FROM k) AS v FROM orders, k), "
    "cs AS (SELECT c.c_custkey + r + n AS v, c.c_nationkey + r AS p, 1 + (SELECT count(*) FROM orders x WHERE x.o_custkey = c.c_custkey) AS size FROM customer c, k), "
    "ns AS (SELECT n_nationkey + r AS v, n_regionkey::BIGINT AS p, 1 + coalesce((SELECT sum(size) FROM cs WHERE cs.p = n_nationkey + r), 0) AS size FROM nation, k), "
    "rs AS (SELECT range AS v, 1 + coalesce((SELECT sum(size) FROM ns WHERE ns.p = range), 0) AS size FROM range((SELECT count(*) FROM region))), "
    "pn AS (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY p ORDER BY size, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ns), "
    "pc AS (SELECT cs.*, pn.pos + 1 + coalesce(sum(cs.size) OVER (PARTITION BY cs.p ORDER BY cs.size, cs.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM cs JOIN pn ON pn.v = cs.p), "
    "po AS (SELECT o.v, o.c AS p, 1 AS size, pc.pos + row_number() OVER (PARTITION BY o.c ORDER BY o.v) AS pos FROM o JOIN pc ON pc.v = o.c) "
    "SELECT v, 0 AS level, NULL::BIGINT AS parent, size::BIGINT AS size, 0::BIGINT AS pos FROM rs UNION ALL SELECT v, 1, p, size::BIGINT, pos::BIGINT FROM pn UNION ALL SELECT v, 2, p, size::BIGINT, pos::BIGINT FROM pc UNION ALL SELECT v, 3, p, size, pos::BIGINT FROM po"
)


@query(_PREORDER)
def tree_preorder(spark, d):
    a, _ = graphs.trade_tree(spark, d)
    tree = G.bfs(a, spark.range(graphs.rows_of(spark, d, "region")).withColumnRenamed("id", "v"))
    return G.preorder(tree).select("v", "level", "parent", "size", "pos")


# every tree has its region, which is its smallest vertex, on top; larger trees come first
@query(
    f"WITH RECURSIVE {TT}, w AS (SELECT range AS v, range AS c FROM range((SELECT count(*) FROM region)) UNION ALL SELECT j, c FROM w JOIN tt ON i = v), "
    f"p AS ({_PREORDER}), t AS (SELECT c, count(*) AS size FROM w GROUP BY c), s AS (SELECT c, (sum(size) OVER (ORDER BY size DESC, c) - size)::BIGINT AS before FROM t) "
    "SELECT p.v, before + p.pos AS pos FROM p JOIN w USING (v) JOIN s USING (c)"
)
def linear_order_of_trees(spark, d):
    a, n = graphs.trade_tree(spark, d)
    return L.linear_order(a, spark.range(n).withColumnRenamed("id", "v"), 0)


def _levels_order_sql(hubs: int, deep: int, along: str = "0") -> str:
    """Hubs, then components breadth first, written out for `deep` levels, then vertices without edges."""
    seen = lambda k: " UNION ALL ".join(f"SELECT v FROM l{x}" for x in range(k + 1))
    levels = ", ".join(
        f"l{k + 1} AS (SELECT v, row_number() OVER (ORDER BY up, v) AS nth FROM (SELECT e.j AS v, min((nth, along)) AS up FROM l{k} JOIN e ON e.i = l{k}.v WHERE e.j NOT IN ({seen(k)}) GROUP BY e.j))"
        for k in range(deep)
    )
    every = " UNION ALL ".join(f"SELECT v, {k} AS level, nth FROM l{k}" for k in range(deep + 1))
    return (
        f"WITH RECURSIVE {US}, dg AS (SELECT v, count(*) AS d FROM (SELECT i AS v FROM us UNION ALL SELECT j FROM us) GROUP BY v), "
        "rk AS (SELECT range AS v, coalesce(d, 0) AS d, row_number() OVER (ORDER BY coalesce(d, 0) DESC, range) - 1 AS rank FROM range((SELECT max(user_id) + 1 FROM events)) LEFT JOIN dg ON dg.v = range), "
        f"mid AS (SELECT v FROM rk WHERE rank >= {hubs} AND d > 0), e AS (SELECT i, j, min({along}) AS along FROM (SELECT i, j, v FROM us UNION ALL SELECT j, i, v FROM us) WHERE i <> j AND i IN (SELECT v FROM mid) AND j IN (SELECT v FROM mid) GROUP BY i, j), "
        "w AS (SELECT v, v AS c FROM mid UNION SELECT e.j, w.c FROM w JOIN e ON e.i = w.v), m AS (SELECT v, min(c) AS component FROM w GROUP BY v), z AS (SELECT component, count(*) AS size FROM m GROUP BY component), "
        f"l0 AS (SELECT DISTINCT component AS v, 0::BIGINT AS nth FROM m), {levels}, a AS ({every}), "
        "p AS (SELECT rk.v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN d > 0 THEN 0 ELSE 2 END AS segment, coalesce(size, 0) AS size, coalesce(component, rank) AS nth_group, coalesce(level, 0) AS level, coalesce(nth, 0) AS nth FROM rk LEFT JOIN m ON m.v = rk.v LEFT JOIN z USING (component) LEFT JOIN a ON a.v = rk.v) "
        "SELECT v, row_number() OVER (ORDER BY segment, size DESC, nth_group, level, nth, v) - 1 AS pos FROM p"
    )


@query(_levels_order_sql(8, 6))
def linear_order_positions(spark, d):
    a, n = graphs.user_steps(spark, d)
    return L.linear_order(a, spark.range(n).withColumnRenamed("id", "v"), 8, "levels")


@query(_levels_order_sql(4, 6, "1 / (1 + v)"))
def linear_order_weighted(spark, d):
    a, n = graphs.user_steps(spark, d)
    return L.linear_order(a.withColumn("along", 1 / (1 + F.col("v"))), spark.range(n).withColumnRenamed("id", "v"), 4, "levels", weight="along")


# Peeling


def _levels(spark, d, block=True, prune=True, levels=4, kind="user"):
    a, n = graphs.user_steps(spark, d) if kind == "user" else graphs.trade_tree(spark, d)
    a = materialise(a, "entries")  # peeled once, and read again for what it is held against
    return peel.peel(spark, a, n, max(2, n // 8), levels, block, prune), a, n


@query(f"WITH {US} SELECT i, j, v, true AS placed, true AS inside FROM us")
def peel_union_equals_input(spark, d):
    return peel.placements(_levels(spark, d)[0]).drop("level")


@query(f"WITH {TT} SELECT i, j, 1.0::DOUBLE AS v, true AS placed, true AS inside FROM tt")
def peel_tree_band(spark, d):
    return peel.placements(_levels(spark, d, block=False, levels=3, kind="tree")[0]).drop("level")


_RULES = "SELECT unnest(['union_equals_input', 'levels_disjoint', 'permutations_bijective', 'structure']) AS rule, 0::BIGINT AS errors"


@query(_RULES)
def peel_invariants_block(spark, d):
    levels, a, _ = _levels(spark, d)
    return peel.invariants(levels, a)


@query(_RULES)
def peel_invariants_band(spark, d):
    levels, a, _ = _levels(spark, d, block=False)
    return peel.invariants(levels, a)


@query(_RULES)
def peel_invariants_noprune(spark, d):
    levels, a, _ = _levels(spark, d, prune=False)
    return peel.invariants(levels, a)


@query("SELECT range AS v, true AS as_vertex, true AS as_place FROM range((SELECT max(user_id) + 1 FROM events))")
def peel_perm_is_bijection(spark, d):
    return peel.places_taken(_levels(spark, d, levels=2)[0])


# two widths side by side; the first is then replaced by another split of the same matrix, and the second stays
@query(f"WITH {US} SELECT i, j, v, width, mode, true AS placed, true AS inside FROM us, (VALUES ('a', 'block'), ('b', 'band')) t(width, mode)")
def level_store_widths(spark, d):
    a, n = graphs.user_steps(spark, d)
    a, sizes = materialise(a, "steps"), {"a": max(2, n // 8), "b": max(3, n // 4)}
    store = LevelStore(spark, f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}")
    store.put(peel.peel(spark, a.withColumn("v", F.lit(0.0)), n, sizes["a"], 2, block=True), sizes["a"], "block")
    store.put(peel.peel(spark, a, n, sizes["b"], 2), sizes["b"], "band")
    store.put(peel.peel(spark, a, n, sizes["a"], 1, block=True), sizes["a"], "block")
    held = [peel.placements(store.get(sizes[w], mode)).drop("level").select("*", F.lit(w).alias("width"), F.lit(mode).alias("mode")) for w, mode in (("a", "block"), ("b", "band"))]
    return held[0].unionByName(held[1])


@query(f"WITH {US} SELECT count(*) AS nnz, (SELECT max(user_id) + 1 FROM events) AS n FROM us")
def peel_meta_totals(spark, d):
    return _levels(spark, d)[0].meta.agg(F.sum("nnz").alias("nnz"), F.max("n").alias("n"))


# Products


def _product_sql(features: int, name: str = "ps", ctes: str = PS, n: str = "(SELECT n FROM n)") -> str:
    return f"WITH {ctes}, {x_sql(features, n)} SELECT a.i AS v, x.f, sum(a.v * x.x) AS x FROM {name} a JOIN x ON x.v = a.j GROUP BY ALL"


_USERS = "(SELECT max(user_id) + 1 FROM events)"


@query(_product_sql(4))
def spmm_direct(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply(a, graphs.dense(spark, n, 4))


@query(_product_sql(4, "nt", f"{NT}", "(SELECT count(*) FROM nation)"))
def spmm_directed(spark, d):
    a, n = graphs.nation_trade(spark, d)
    return spmm.multiply(a, graphs.dense(spark, n, 4))


@query(f"WITH {PS}, {x_sql(16)}, y AS (SELECT a.i AS v, x.f, sum(a.v * x.x) AS x FROM ps a JOIN x ON x.v = a.j GROUP BY ALL) SELECT v, " + ", ".join(f"max(x) FILTER (f = {k}) AS f{k}" for k in range(16)) + " FROM y GROUP BY v")
def spmm_k_features(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_wide(a, graphs.dense_wide(spark, n, 16), [f"f{k}" for k in range(16)])


@query(
    f"WITH {PS}, e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT count(*) AS c FROM embeddings) "
    "SELECT a.i AS v, e.f::INT AS f, round(sum(a.v * e.x), 6) AS x FROM ps a, c JOIN e ON e.vec_id = a.j % c.c GROUP BY ALL"
)
def spmm_embeddings(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_compressed(spmm.compressed_tiles(a), *graphs.dense_embeddings(spark, d, n)).withColumn("x", F.round("x", 6))


@query(_product_sql(4, "us", US, _USERS))
def spmm_leveled(spark, d):
    levels, _, n = _levels(spark, d)
    return spmm.multiply_levels(levels, graphs.dense(spark, n, 4))


@query(_product_sql(4))
def spmm_tiled(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_tiles(a, graphs.dense(spark, n, 4), 256)


@query(_product_sql(4))
def spmm_slim(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_owned(a, graphs.dense(spark, n, 4), 256)


@query(_product_sql(4))
def spmm_15d(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_replicated(a, graphs.dense(spark, n, 4), n, 8, 2)


@query(_product_sql(4))
def spmm_slice(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_slices(a, graphs.dense(spark, n, 4), E.even_ranges(spark, n, 8))


@query(f"WITH {PS}, {x_sql(4)}, y AS (SELECT a.i AS v, x.f, sum(a.v * x.x) AS x FROM ps a JOIN x ON x.v = a.j GROUP BY ALL UNION ALL SELECT v, f, x FROM x) SELECT v, f, sum(x) AS x FROM y GROUP BY ALL")
def spmm_slice_add(spark, d):
    a, n = graphs.part_supplier(spark, d)
    x = graphs.dense(spark, n, 4)
    return spmm.multiply_slices(a, x, E.even_ranges(spark, n, 8), start=x)


_STEP = "y{k} AS (SELECT a.i AS v, y.f, sum(a.v * y.x) AS x FROM nt a JOIN y{b} y ON y.v = a.j GROUP BY ALL)"


@query(f"WITH {NT}, {x_sql(2, '(SELECT count(*) FROM nation)')}, y0 AS (SELECT * FROM x), {_STEP.format(k=1, b=0)}, {_STEP.format(k=2, b=1)}, {_STEP.format(k=3, b=2)} SELECT v, f, x FROM y3")
def spmm_iterated_3(spark, d):
    a, n = graphs.nation_trade(spark, d)
    a = materialise(a, "a")
    return spmm.iterate(lambda x: spmm.multiply(a, x), graphs.dense(spark, n, 2), 3)


# what the writes of the steps saw, without jobs of their own
@query(
    f"WITH {NT}, {x_sql(2, '(SELECT count(*) FROM nation)')}, y0 AS (SELECT * FROM x), {_STEP.format(k=1, b=0)}, {_STEP.format(k=2, b=1)}, {_STEP.format(k=3, b=2)}, "
    "y AS (SELECT 1 AS iteration, x FROM y1 UNION ALL SELECT 2, x FROM y2 UNION ALL SELECT 3, x FROM y3), "
    "s AS (SELECT iteration, count(*)::DOUBLE AS rows, sum(x) AS total, max(abs(x)) AS largest FROM y GROUP BY iteration) "
    "SELECT iteration::BIGINT AS iteration, name, value FROM s UNPIVOT (value FOR name IN (rows, total, largest))"
)
def iteration_metrics(spark, d):
    a, n = graphs.nation_trade(spark, d)
    a, log = materialise(a, "a"), metrics.MetricLog(spark, "run")
    spmm.iterate(lambda x: spmm.multiply(a, x), graphs.dense(spark, n, 2), 3, log=log)
    return log.table().select("iteration", "name", "value")


@query(f"WITH {US}, {x_sql(2, _USERS)}, y0 AS (SELECT * FROM x), {_STEP.format(k=1, b=0)}, {_STEP.format(k=2, b=1)}, {_STEP.format(k=3, b=2)} SELECT v, max(x) FILTER (f = 0) AS f0, max(x) FILTER (f = 1) AS f1 FROM y3 GROUP BY v".replace("FROM nt a", "FROM us a"))
def spmm_stationary_3(spark, d):
    a, n = graphs.user_steps(spark, d)
    return spmm.iterate_stationary(a, graphs.dense_wide(spark, n, 2), 3)


@query(f"WITH {PS}, {x_sql(4)} SELECT a.i AS v, x.f, sum(a.v * x.x) AS x FROM ps a JOIN x ON x.v = a.j WHERE a.i // 256 = 0 GROUP BY ALL")
def head_reduce(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return spmm.multiply_tiles(a.where(F.expr("i div 256 = 0")), graphs.dense(spark, n, 4), 256)


@query(f"WITH {PS}, {x_sql(4)} SELECT v, f, 2 * x AS x FROM x")
def level_scatter_add(spark, d):
    perm, n = _two_levels(spark, d)
    x = graphs.dense(spark, n, 4)
    moved = perm.join(x, "v").select("level", "pos", "f", "x")
    return moved.join(perm, ["level", "pos"]).groupBy("v", "f").agg(F.sum("x").alias("x"))


# Slices and exchange tables

_RANGES = "r AS (SELECT range AS part, least(range * s, n) AS lo, least((range + 1) * s, n) AS hi FROM range(8), (SELECT n, ceil(n / 8)::BIGINT AS s FROM n))"
_RECEIVE = f"{PS}, {_RANGES}, t AS (SELECT DISTINCT p.part, q.part AS owner, a.j FROM ps a JOIN r p ON a.i >= p.lo AND a.i < p.hi JOIN r q ON a.j >= q.lo AND a.j < q.hi WHERE p.part <> q.part)"


def _receive(spark, d):
    a, n = graphs.part_supplier(spark, d)
    ranges = E.even_ranges(spark, n, 8)
    return E.receive_table(a, ranges), ranges


@query("WITH s AS (SELECT c_nationkey AS part, count(*) AS n FROM customer GROUP BY ALL) SELECT part, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY part))::BIGINT AS hi FROM s")
def slice_ranges(spark, d):
    sizes = graphs.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("part")).agg(F.count("*").alias("n"))
    return E.slice_ranges(sizes)


@query(f"WITH {PS}, {_RANGES} SELECT DISTINCT j, part AS owner FROM ps JOIN r ON j >= lo AND j < hi")
def owner_lookup(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return E.with_owner(M.used_columns(a), E.even_ranges(spark, n, 8), "j", "owner")


@query(f"WITH {_RECEIVE} SELECT part, owner, j FROM t")
def recv_table(spark, d):
    return _receive(spark, d)[0]


@query(f"WITH {_RECEIVE} SELECT owner, part, j, row_number() OVER (PARTITION BY owner, part ORDER BY j) - 1 AS nth FROM t")
def send_table(spark, d):
    return E.send_table(_receive(spark, d)[0])


@query("SELECT 0::BIGINT AS errors")
def exchange_tables_agree(spark, d):
    received = materialise(_receive(spark, d)[0], "received")
    return E.tables_agree(received, E.send_table(received))


_COUNTS = f"{_RECEIVE}, c AS (SELECT p.part, q.part AS owner, (SELECT count(*) FROM t WHERE t.part = p.part AND t.owner = q.part) AS rows FROM r p, r q)"


@query(f"WITH {_COUNTS} SELECT part, owner, rows FROM c")
def peer_counts(spark, d):
    return E.peer_counts(*_receive(spark, d))


@query(f"WITH {_COUNTS} SELECT part, owner, rows, coalesce(sum(rows) OVER (PARTITION BY part ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM c")
def displacements(spark, d):
    return E.displacements(E.peer_counts(*_receive(spark, d)))


@query(f"WITH {PS}, {_RANGES}, u AS (SELECT DISTINCT p.part, q.part AS owner, a.j FROM ps a JOIN r p ON a.i >= p.lo AND a.i < p.hi JOIN r q ON a.j >= q.lo AND a.j < q.hi) SELECT count(*) FILTER (part = owner) AS local, count(*) FILTER (part <> owner) AS fetched FROM u")
def exchange_volume(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return E.volume(a, E.even_ranges(spark, n, 8))


@query(f"WITH {PS}, {_RANGES} SELECT i, j, v, j >= lo AND j < hi AS local FROM ps JOIN r ON i >= lo AND i < hi")
def local_columns(spark, d):
    a, n = graphs.part_supplier(spark, d)
    owned = E.with_owner(E.with_owner(a, E.even_ranges(spark, n, 8), "i", "p"), E.even_ranges(spark, n, 8), "j", "q")
    return owned.select("i", "j", "v", (F.col("p") == F.col("q")).alias("local"))


@query(f"WITH {PS}, {_RANGES} SELECT i, j, v, part AS owner, j - lo AS at FROM ps JOIN r ON j >= lo AND j < hi")
def local_indices(spark, d):
    a, n = graphs.part_supplier(spark, d)
    return E.localised(a, E.even_ranges(spark, n, 8), "j")


# Errors, statistics, scalars, generators


@query("SELECT 0.0::DOUBLE AS relative_l2, 0.0::DOUBLE AS max_abs, true AS close")
def error_norms(spark, d):
    a, n = graphs.part_supplier(spark, d)
    x = graphs.dense(spark, n, 4)
    return metrics.error_norms(spmm.multiply_tiles(a, x, 256), spmm.multiply(a, x))


@query("SELECT event_type AS name, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY ALL")
def runtime_stats(spark, d):
    rows = graphs.table(spark, d, "events").select(F.col("event_type").alias("name"), "value")
    return metrics.runtime_stats(rows).select("name", "n", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS flag, trunc(abs(value) * 1000)::BIGINT AS ms, event_id + 1 AS p, pow(2, floor(log2(event_id + 1) / 2 + 1e-12))::BIGINT AS copies FROM events")
def scalar_helpers(spark, d):
    e = graphs.table(spark, d, "events")
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("F"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", S.to_bool(word).alias("flag"), S.to_ms(F.abs("value")).alias("ms"), (F.col("event_id") + 1).alias("p"), S.replication(F.col("event_id") + 1).alias("copies"))


def _scramble_sql(x: str, seed: int) -> str:
    return f"(((({x}) % 2147483647) * 1103515245 + 12345 + {seed}) % 2147483647 * 48271 + {seed}) % 2147483647"


@query(f"WITH c AS (SELECT a.range AS i, a.range * 10 + b.range AS k FROM range(2000) a, range(10) b) SELECT i, {_scramble_sql('k', 42)} % 3000 AS j, round(sum({_scramble_sql('k', 43)} % 1000 / 1000), 6) AS v FROM c GROUP BY ALL")
def gen_sparse(spark, d):
    return generators.sparse(spark, 2000, 3000, 20000).withColumn("v", F.round("v", 6))


@query(f"SELECT a.range AS v, b.range::INT AS f, round(2 * ({_scramble_sql('a.range * 4 + b.range', 42)} % 1000) / 1000 - 1, 6) AS x FROM range(2000) a, range(4) b")
def gen_dense(spark, d):
    return generators.dense(spark, 2000, 4).withColumn("x", F.round("x", 6))


@query(f"WITH c AS (SELECT a.range AS i, a.range * 4 + b.range AS k FROM range(1, 3000) a, range(4) b), s AS (SELECT i, {_scramble_sql('k', 42)} / 2147483647 AS s FROM c) SELECT DISTINCT i, floor(i * s * s)::BIGINT AS j, 1.0::DOUBLE AS v FROM s")
def gen_attachment(spark, d):
    return generators.attachment(spark, 3000, 4)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem")
def global_positions(spark, d):
    return number_rows(graphs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def runs_not_logged(spark, d):
    runs = graphs.table(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct()
    return metrics.not_logged(runs, graphs.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))).withColumnRenamed("run_id", "user_id")


