"""Queries of the graph operators over the driver's tables, each with its SQL where SQL can express it.

Graphs: SP joins suppliers and parts (part ids offset by PART) that share a line; NN weighs customer nations to supplier nations by
lines; PP joins parts that share an order. Vectors and matrices come from the lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import algebra, arrays
from .operators import linkpred, matrix, partition, vector, walk, word2vec
from .operators.closed import closed_paths
from .operators.graph import Graph
from .sources.text import walk_lines

PART, PARTS, SEED = 1_000_000_000, 8, 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SP_SQL = f"sp AS (SELECT DISTINCT l_suppkey AS src, l_partkey + {PART} AS dst FROM lineitem), arcs AS (SELECT src, dst FROM sp UNION ALL SELECT dst, src FROM sp)"
NN_SQL = "nn AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
UV_SQL = "u AS (SELECT l_partkey AS idx, sum(l_quantity) AS val FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), w AS (SELECT l_partkey AS idx, CAST(count(*) AS DOUBLE) AS val FROM lineitem WHERE l_discount = 0.0 GROUP BY 1)"
AB_SQL = "a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"
PP_SQL = "lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), pp AS (SELECT DISTINCT x.p AS src, y.p AS dst FROM lines x JOIN lines y ON x.o = y.o AND x.p < y.p)"
WORDS_SQL = r"words AS MATERIALIZED (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word, generate_subscripts(string_split_regex(text, '\s+'), 1) AS pos FROM documents), vocab AS MATERIALIZED (SELECT word, count(*) AS cn, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS idx FROM words WHERE word <> '' GROUP BY word HAVING count(*) >= 5)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def named(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = sql


def sp(spark: SparkSession, d: str) -> Graph:
    line = table(spark, d, "lineitem")
    return Graph(line.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst")).distinct())


def nn(spark: SparkSession, d: str) -> DataFrame:
    """Lines by (customer nation, supplier nation): counted by keys before the small tables are joined."""
    line, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_nationkey").cast("bigint").alias("i"), F.col("s_nationkey").cast("bigint").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def pp(spark: SparkSession, d: str) -> DataFrame:
    """(i, j) of parts that share an order, i < j; a pair that shares several comes several times."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    return lines.withColumnRenamed("p", "i").join(lines.withColumnRenamed("p", "j"), "o").where("i < j").select("i", "j")


def u_w(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem")
    u = line.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("idx")).agg(F.sum("l_quantity").alias("val"))
    w = line.where("l_discount = 0.0D").groupBy(F.col("l_partkey").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return u, w


def a_b(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem")
    by = [F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")]
    return line.where("l_returnflag = 'R'").groupBy(*by).agg(F.sum("l_quantity").alias("v")), line.where("l_returnflag = 'A'").groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("v"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("vec"))


# graph views


@query(f"WITH {SP_SQL}, deg AS (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM arcs GROUP BY 1) SELECT dst AS node, sum(d) AS val FROM arcs JOIN deg USING (src) GROUP BY 1")
def neighbour_degree_vxm(spark, d):
    g = sp(spark, d)
    degree = g.degrees().select(F.col("node").alias("idx"), F.col("degree").cast("double").alias("val"))
    return vector.vxm(degree, g.arcs().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))).select(F.col("idx").alias("node"), "val")


@query("SELECT count(*) AS n_edges FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def edge_count(spark, d):
    return sp(spark, d).edges.agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"WITH {SP_SQL} SELECT DISTINCT src AS node FROM arcs")
def node_list(spark, d):
    return sp(spark, d).nodes()


@query(f"WITH {SP_SQL} SELECT src, dst, 1.0::DOUBLE AS weight FROM sp")
def edge_triplets(spark, d):
    return sp(spark, d).triplets()


@query(f"WITH {SP_SQL} SELECT src, dst FROM sp")
def edge_list(spark, d):
    return sp(spark, d).edge_list()


@query(f"WITH {SP_SQL} SELECT src AS node, count(*) AS degree FROM arcs GROUP BY 1")
def degree(spark, d):
    return sp(spark, d).degrees()


@query(f"WITH {NN_SQL} SELECT i AS src, string_agg(CAST(j AS VARCHAR) || ':' || CAST(CAST(v AS BIGINT) AS VARCHAR), ' ' ORDER BY j) AS adj FROM nn GROUP BY 1")
def adjacency_sorted(spark, d):
    g = Graph(nn(spark, d).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("weight")), directed=True)
    text = F.transform("adj", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["weight"].cast("bigint").cast("string")))
    return g.adjacency().select("src", F.array_join(text, " ").alias("adj"))


@query(f"WITH {SP_SQL} SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM arcs GROUP BY 1")
def neighbors(spark, d):
    return sp(spark, d).neighbors().select("node", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


def _hashed(spark, d):
    return partition.hash_partition(sp(spark, d).nodes(), PARTS).withColumn("pos", F.col("node"))


IDS_SQL = f"{SP_SQL}, ids AS (SELECT node, row_number() OVER (ORDER BY node % {PARTS}, node) - 1 AS id FROM (SELECT DISTINCT src AS node FROM arcs))"


@query(f"WITH {IDS_SQL} SELECT x.id AS i, y.id AS j, 1.0::DOUBLE AS v FROM arcs JOIN ids x ON src = x.node JOIN ids y ON dst = y.node")
def relabel_matrix(spark, d):
    return sp(spark, d).to_matrix(partition.relabel(_hashed(spark, d)))


@query(f"WITH {IDS_SQL} SELECT x.id AS i, y.id AS j, CAST(x.id AS DOUBLE) AS v FROM arcs JOIN ids x ON src = x.node JOIN ids y ON dst = y.node")
def relabel_matrix_ids(spark, d):
    return sp(spark, d).to_matrix(partition.relabel(_hashed(spark, d)), ids_as_values=True)


# algebra

_PRODUCTS = {"plus_mul": ("sum(x * v)", "x * v"), "plus_min": ("sum(least(x, v))", ""), "min_mul": ("min(x * v)", ""), "min_plus": ("min(x + v)", ""), "maxfrac_plus": ("arg_max(x + v, struct_pack(f := (x + v) - floor(x + v), n := -(x + v)))", "")}


def _vxm(name: str) -> None:
    def run(spark, d, name=name):
        v = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), (F.length("n_name") / F.lit(8.0) + F.col("n_regionkey")).alias("val"))
        return vector.vxm(v, nn(spark, d), algebra.SEMIRINGS[name])

    named(f"semiring_{name}_vxm", run, f"WITH {NN_SQL}, n AS (SELECT CAST(n_nationkey AS BIGINT) AS i, length(n_name) / 8.0::DOUBLE + n_regionkey AS x FROM nation) SELECT j AS idx, {_PRODUCTS[name][0]} AS val FROM nn JOIN n USING (i) GROUP BY 1")


for _name in algebra.SEMIRINGS:
    _vxm(_name)

_FULL = "FROM u FULL JOIN w ON u.idx = w.idx"
_IDX = "coalesce(u.idx, w.idx) AS idx"
for _name, _fn, _sql in (
    ("vec_add", vector.add, f"SELECT {_IDX}, coalesce(u.val, 0) + coalesce(w.val, 0) AS val {_FULL} WHERE coalesce(u.val, 0) + coalesce(w.val, 0) <> 0"),
    ("vec_mul_union", vector.multiply_union, f"SELECT {_IDX}, coalesce(u.val, 1) * coalesce(w.val, 1) AS val {_FULL}"),
    ("vec_mul_intersect", vector.multiply_intersect, "SELECT u.idx, u.val * w.val AS val FROM u JOIN w ON u.idx = w.idx"),
    ("vec_mul_zero_filled", vector.multiply_zero_filled, f"SELECT {_IDX}, coalesce(u.val, 0) * coalesce(w.val, 0) AS val {_FULL}"),
    ("vec_div", vector.divide, "SELECT u.idx, u.val / w.val AS val FROM u JOIN w ON u.idx = w.idx"),
    ("vec_div_zero_filled", vector.divide_zero_filled, f"SELECT {_IDX}, coalesce(u.val / w.val, 0) AS val {_FULL}"),
    ("vec_cooperate_min", lambda a, b: vector.cooperate(a, b, algebra.MIN_MONOID), f"SELECT {_IDX}, least(u.val, w.val) AS val {_FULL}"),
    ("vec_cooperate_max", lambda a, b: vector.cooperate(a, b, algebra.MAX_MONOID), f"SELECT {_IDX}, greatest(u.val, w.val) AS val {_FULL}"),
    ("vec_cooperate_first", vector.first_of, f"SELECT {_IDX}, coalesce(u.val, 0) AS val {_FULL}"),
    ("vec_mask", vector.mask, "SELECT * FROM u WHERE idx IN (SELECT idx FROM w)"),
    ("vec_mask_complement", lambda a, b: vector.mask(a, b, complement=True), "SELECT * FROM u WHERE idx NOT IN (SELECT idx FROM w)"),
    ("vec_dot", vector.dot, "SELECT coalesce(sum(u.val * w.val), 0) AS dot FROM u JOIN w ON u.idx = w.idx"),
    ("vec_scale", lambda a, b: vector.scale(a, 10.0), "SELECT idx, 10.0::DOUBLE * val AS val FROM u"),
    ("vec_scale_min", lambda a, b: vector.scale(a, 10.0, algebra.MIN), "SELECT idx, least(10.0::DOUBLE, val) AS val FROM u"),
    ("vec_ids", lambda a, b: vector.ids(a), "SELECT idx, CAST(idx AS DOUBLE) AS val FROM u"),
):
    named(_name, lambda s, d, fn=_fn: fn(*u_w(s, d)), f"WITH {UV_SQL} {_sql}")


@query(f"WITH {UV_SQL}, n AS (SELECT unnest(range((SELECT max(p_partkey) + 1 FROM part))) AS idx) SELECT n.idx, coalesce(val, 0.0::DOUBLE) AS val FROM n LEFT JOIN u ON n.idx = u.idx")
def vec_densify(spark, d):
    size = table(spark, d, "part").agg(F.max("p_partkey")).head()[0] + 1
    return vector.densify(u_w(spark, d)[0], size)


_CELLS = "a FULL JOIN b ON a.i = b.i AND a.j = b.j"
_CELL = "coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j"
for _name, _fn, _sql in (
    ("mat_add", matrix.add, f"SELECT {_CELL}, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM {_CELLS}"),
    ("mat_subtract", matrix.subtract, f"SELECT {_CELL}, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM {_CELLS} WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)"),
    ("mat_hadamard", matrix.hadamard, "SELECT a.i, a.j, a.v * b.v AS v FROM a JOIN b ON a.i = b.i AND a.j = b.j"),
    ("mat_row_union_multiply", matrix.row_union_multiply, f"SELECT {_CELL}, coalesce(a.v, 1) * coalesce(b.v, 1) AS v FROM {_CELLS} WHERE coalesce(a.i, b.i) IN (SELECT i FROM a) AND coalesce(a.i, b.i) IN (SELECT i FROM b)"),
    ("mat_div", matrix.divide, "SELECT a.i, a.j, a.v / b.v AS v FROM a JOIN b ON a.i = b.i AND a.j = b.j"),
    ("mat_combine_max", lambda a, b: matrix.combine(a, b, algebra.MAX), f"SELECT {_CELL}, greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS v FROM {_CELLS}"),
    ("mat_mask", matrix.mask, "SELECT a.* FROM a SEMI JOIN b ON a.i = b.i AND a.j = b.j"),
    ("mat_mask_complement", lambda a, b: matrix.mask(a, b, complement=True), "SELECT a.* FROM a ANTI JOIN b ON a.i = b.i AND a.j = b.j"),
    ("mat_transpose", lambda a, b: matrix.transpose(a), "SELECT j AS i, i AS j, v FROM a"),
    ("mat_spgemm", lambda a, b: matrix.multiply(a, matrix.transpose(b)), "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2"),
    ("mat_spgemm_min_plus", lambda a, b: matrix.multiply(a, matrix.transpose(b), algebra.MIN_PLUS), "SELECT a.i, b.i AS j, min(a.v + b.v) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2"),
    ("mat_gemm", lambda a, b: matrix.gemm(2.0, a, matrix.transpose(b), -1.0, matrix.multiply(b, matrix.transpose(a))), "SELECT i, j, sum(v) AS v FROM (SELECT a.i, b.i AS j, sum(2 * a.v * b.v) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2 UNION ALL SELECT b.i, a.i AS j, -sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2) GROUP BY 1, 2 HAVING sum(v) <> 0"),
    ("mat_dims", lambda a, b: matrix.dimensions(a), "SELECT max(i) + 1 AS n_rows, max(j) + 1 AS n_cols FROM a"),
    ("mat_validate", lambda a, b: matrix.violations(a.unionByName(b), 10, 100), "SELECT i, j, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2 HAVING count(*) > 1 OR i >= 10 OR j >= 100"),
    ("mat_horzcat", lambda a, b: matrix.horzcat(a, b, PART), f"SELECT * FROM a UNION ALL SELECT i, j + {PART}, v FROM b"),
    ("mat_vertcat", lambda a, b: matrix.vertcat(a, b, PART), f"SELECT * FROM a UNION ALL SELECT i + {PART}, j, v FROM b"),
    ("mat_blocks", lambda a, b: matrix.grid_partition(matrix.with_blocks(a, 16, 64), 2, 4, 5), "SELECT i, j, v, i // 16 AS bi, j // 64 AS bj, i // 32 + j // 256 * 5 AS part FROM a"),
):
    named(_name, lambda s, d, fn=_fn: fn(*a_b(s, d)), f"WITH {AB_SQL} {_sql}")


@query("SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def mat_from_coo(spark, d):
    return matrix.from_coo(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")))


@query(f"WITH {UV_SQL} SELECT idx AS i, idx AS j, val AS v FROM u")
def mat_spdiag(spark, d):
    return matrix.spdiag(u_w(spark, d)[0])


@query(f"WITH {NN_SQL}, x AS (SELECT i AS idx, sum(v) AS val FROM nn GROUP BY 1) SELECT p.idx AS i, q.idx AS j, 2 * p.val * q.val + coalesce(v, 0) AS v FROM x p CROSS JOIN x q LEFT JOIN nn ON p.idx = i AND q.idx = j")
def mat_rank_one(spark, d):
    m = nn(spark, d)
    return matrix.rank_one(2.0, m.groupBy(F.col("i").alias("idx")).agg(F.sum("v").alias("val")), m)


@query(f"WITH {AB_SQL}, {UV_SQL}, y AS (SELECT l_suppkey AS idx, CAST(count(*) AS DOUBLE) AS val FROM lineitem GROUP BY 1) SELECT idx, sum(val) AS val FROM (SELECT i AS idx, 2 * v * val AS val FROM a JOIN w ON j = idx UNION ALL SELECT idx, -val FROM y) GROUP BY 1")
def mat_gemv(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return matrix.gemv(2.0, a_b(spark, d)[0], u_w(spark, d)[1], -1.0, y)


def _ones(g: Graph) -> DataFrame:
    return g.arcs().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))


@query(f"WITH {SP_SQL} SELECT x.src AS i, y.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM sp x JOIN sp z ON x.dst = z.dst JOIN (SELECT DISTINCT src AS s, src AS dst FROM sp) y ON z.src = y.s GROUP BY 1, 2")
def two_hop_count(spark, d):
    e = sp(spark, d).edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    return matrix.multiply(e, matrix.transpose(e))


@query(f"WITH {SP_SQL} SELECT x.src AS u, y.src AS v, count(*) AS common FROM sp x JOIN sp y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2")
def common_neighbors(spark, d):
    return two_hop_count(spark, d).where("i < j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("v").cast("bigint").alias("common"))


@query(f"WITH {PP_SQL} SELECT count(*) AS triangles FROM pp a JOIN pp b ON a.dst = b.src JOIN pp c ON c.src = a.src AND c.dst = b.dst")
def triangle_count(spark, d):
    return matrix.triangles(pp(spark, d))


@query(f"WITH {PP_SQL} SELECT a.src AS i, b.dst AS j, CAST(count(*) AS DOUBLE) AS v FROM pp a JOIN pp b ON a.dst = b.src JOIN pp c ON c.src = a.src AND c.dst = b.dst GROUP BY 1, 2")
def masked_spgemm(spark, d):
    return closed_paths(pp(spark, d)).select("i", "j", F.col("v").cast("double").alias("v"))


# partitioning


@query(f"WITH {SP_SQL} SELECT DISTINCT src AS node, CAST(src % {PARTS} AS INTEGER) AS part FROM arcs")
def hash_partition(spark, d):
    return partition.hash_partition(sp(spark, d).nodes(), PARTS)


#: Jobs one by one, each to the first bin of least load; for small tables.
_LPT = f"""
    WITH RECURSIVE {SP_SQL}, o AS MATERIALIZED (SELECT src AS node, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS pos FROM arcs GROUP BY 1),
    r AS (SELECT CAST(-1 AS BIGINT) AS pos, [CAST(0 AS BIGINT) FOR k IN range({PARTS})] AS loads, CAST(0 AS BIGINT) AS part
          UNION ALL SELECT o.pos, [loads[k] + CASE WHEN k = p THEN degree ELSE 0 END FOR k IN range(1, {PARTS + 1})], p - 1
          FROM (SELECT pos, loads, list_position(loads, list_min(loads)) AS p FROM r) q JOIN o ON o.pos = q.pos + 1)
    SELECT node, degree, CAST(part AS INTEGER) AS part, pos FROM o JOIN r USING (pos)"""


@query(_LPT)
def lpt_partition(spark, d):
    return partition.lpt_partition(sp(spark, d).degrees(), PARTS)


#: Nodes one by one in ascending order, each to the first part of highest score; the list of all parts so far goes along: for small tables.
_LDG = f"""
    WITH RECURSIVE {SP_SQL}, ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT DISTINCT src AS node FROM arcs)),
    n AS MATERIALIZED (SELECT x.k, x.node, list(y.k) AS near, count(*) AS degree FROM arcs JOIN ids x ON src = x.node JOIN ids y ON dst = y.node GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT CAST(floor(count(*)::DOUBLE / {PARTS} + 1) AS BIGINT) * 2 AS capacity FROM sp),
    r AS (SELECT CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT) FOR p IN range({PARTS})] AS loads, CAST([] AS BIGINT[]) AS parts
          UNION ALL SELECT k, [loads[p] + CASE WHEN p = best THEN degree ELSE 0 END FOR p IN range(1, {PARTS + 1})], list_append(parts, best)
          FROM (SELECT k, loads, parts, degree, list_position(scores, list_max(scores)) AS best
                FROM (SELECT k, loads, parts, degree, [CASE WHEN w[p] > 0 THEN (1 + shared[p]) * w[p] WHEN shared[p] > 0 THEN 0.0::DOUBLE ELSE w[p] END FOR p IN range(1, {PARTS + 1})] AS scores
                      FROM (SELECT n.k, loads, parts, degree, [1 - (loads[p] + degree)::DOUBLE / capacity FOR p IN range(1, {PARTS + 1})] AS w,
                                   [len(list_filter(met, lambda x: x = p)) FOR p IN range(1, {PARTS + 1})] AS shared
                            FROM (SELECT n.k, loads, parts, degree, capacity, [parts[x] FOR x IN near IF x < n.k] AS met FROM r JOIN n ON n.k = r.k + 1, c) n))))
    SELECT node, degree, CAST(last.parts[n.k] - 1 AS INTEGER) AS part, node AS pos FROM n, (SELECT parts FROM r ORDER BY k DESC LIMIT 1) last"""


@query(_LDG)
def ldg_partition(spark, d):
    return partition.ldg_partition(sp(spark, d), PARTS)


@query(f"WITH {SP_SQL}, n AS (SELECT CAST(node % {PARTS} AS INTEGER) AS part, count(*) AS n FROM (SELECT DISTINCT src AS node FROM arcs) GROUP BY 1), k AS (SELECT CAST(unnest(range({PARTS})) AS INTEGER) AS part) SELECT k.part, CAST(coalesce(sum(n) OVER (ORDER BY k.part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k LEFT JOIN n ON k.part = n.part")
def partition_thresholds(spark, d):
    return partition.thresholds(_hashed(spark, d), PARTS)


@query(f"WITH {IDS_SQL} SELECT id, CAST(node % {PARTS} AS INTEGER) AS part FROM ids")
def index_lookup(spark, d):
    a = _hashed(spark, d)
    return partition.locate(partition.relabel(a).select("id"), partition.thresholds(a, PARTS))


@query(f"WITH {SP_SQL} SELECT count(*) AS n_edges, CAST(sum(CASE WHEN src % {PARTS} <> dst % {PARTS} THEN 1 ELSE 0 END) AS BIGINT) AS n_cut, avg(CASE WHEN src % {PARTS} <> dst % {PARTS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cut_rate FROM sp")
def edge_cut(spark, d):
    return partition.edge_cut(sp(spark, d), _hashed(spark, d))


# walks

WALKS, STEPS = 2, 4


def _walk_sql(steps: int) -> str:
    steps_sql, prev = [], "w0"
    for k in range(1, steps + 1):
        steps_sql.append(f"s{k} AS (SELECT walk, dst AS node, arg_max(src, md5('{SEED}:' || walk || ':{k}:' || src)) AS nxt FROM arcs, rounds GROUP BY 1, 2), w{k} AS (SELECT {prev}.walk, src, nxt AS cur, path || ' ' || nxt AS path FROM {prev} JOIN s{k} ON {prev}.walk = s{k}.walk AND cur = node)")
        prev = f"w{k}"
    return f"WITH {SP_SQL}, rounds AS (SELECT unnest(range({WALKS})) AS walk), w0 AS (SELECT walk, src, src AS cur, CAST(src AS VARCHAR) AS path FROM (SELECT DISTINCT src FROM arcs), rounds), " + ", ".join(steps_sql)


@query(f"{_walk_sql(1)} SELECT walk, node, nxt AS next FROM s1")
def walk_step(spark, d):
    return walk.step_table(sp(spark, d).arcs(), WALKS, 1, SEED)


@query(f"{_walk_sql(STEPS)} SELECT walk, src, path FROM w{STEPS}")
def random_walk(spark, d):
    paths = walk.random_walks(sp(spark, d).arcs(), WALKS, STEPS, SEED)
    return paths.select("walk", "src", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@query(f"{_walk_sql(2)} SELECT path AS value FROM w2")
def walk_text(spark, d):
    return walk_lines(walk.random_walks(sp(spark, d).arcs(), WALKS, 2, SEED))


def _weighted_sql(steps: int) -> str:
    unit = f"(CAST('0x' || substr(md5('{SEED}:' || w.walk || ':' || w.src || ':%d:' || j), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
    out = [f"w{k} AS (SELECT walk, src, arg_min(j, t) AS cur, any_value(path) || ' ' || arg_min(j, t) AS path FROM (SELECT w.walk, w.src, j, path, -ln({unit % k}) / v AS t FROM w{k - 1} w JOIN nn ON cur = i) GROUP BY 1, 2)" for k in range(1, steps + 1)]
    return f"WITH {NN_SQL}, w0 AS (SELECT walk, i AS src, i AS cur, CAST(i AS VARCHAR) AS path FROM (SELECT DISTINCT i FROM nn), (SELECT unnest(range({WALKS})) AS walk)), {', '.join(out)} SELECT walk, src, path FROM w{steps}"


@query(_weighted_sql(STEPS))
def walk_weighted(spark, d):
    arcs = nn(spark, d).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("weight"))
    return walk.weighted_walks(arcs, WALKS, STEPS, SEED).select("walk", "src", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


# embeddings


@query(f"WITH {WORDS_SQL} SELECT word, cn, idx FROM vocab")
def vocabulary(spark, d):
    return word2vec.vocabulary(tokens(spark, d), 5)


@query(f"WITH {WORDS_SQL}, t AS (SELECT sum(cn) AS total FROM vocab) SELECT word, round((sqrt(cn / (0.001::DOUBLE * total) + 1)) / (cn / (0.001::DOUBLE * total)), 9) AS keep FROM vocab, t")
def subsample_probability(spark, d):
    return word2vec.keep_probability(vocabulary(spark, d), 0.001).select("word", F.round("keep", 9).alias("keep"))


@query(f"WITH {WORDS_SQL}, t AS (SELECT sum(cn ** 0.75::DOUBLE) AS total FROM vocab) SELECT word, round(cn ** 0.75::DOUBLE / total, 9) AS prob FROM vocab, t")
def unigram_probability(spark, d):
    return word2vec.unigram_probability(vocabulary(spark, d)).select("word", F.round("prob", 9).alias("prob"))


@query(f"WITH {WORDS_SQL}, k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 100 AS chunk FROM words WHERE word IN (SELECT word FROM vocab)) SELECT doc_id, chunk, count(*) AS n_words FROM k GROUP BY 1, 2")
def sentence_chunks(spark, d):
    t = tokens(spark, d)
    return word2vec.sentence_chunks(t, word2vec.vocabulary(t, 5), 100, "doc_id")


@query("SELECT label, k - 1 AS k, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2")
def document_embedding_mean(spark, d):
    v = vectors(spark, d)
    docs = v.groupBy("label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("tokens"))
    words = v.select(F.col("vec_id").cast("string").alias("word"), F.col("vec").alias("vector"))
    size = v.select(F.size("vec")).head()[0]
    return word2vec.document_vectors(docs, words, size, "label", "tokens").select("label", F.posexplode("vector").alias("k", "x")).select("label", F.col("k").cast("bigint").alias("k"), F.round("x", 5).alias("x"))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT CAST(e.vec_id AS VARCHAR) AS word, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, 1 LIMIT 10")
def synonyms_topk(spark, d):
    words = vectors(spark, d).select(F.col("vec_id").cast("string").alias("word"), "vec", F.col("vec").alias("vector"))
    return word2vec.Model(words, 64).find_synonyms("0", 10).select("word", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT CAST(e.vec_id AS VARCHAR) AS word, round({_COS}, 6) AS similarity FROM embeddings e, (SELECT [CAST(i AS DOUBLE) FOR i IN range(64)] AS embedding) q ORDER BY {_COS} DESC, 1 LIMIT 10")
def synonyms_by_vector(spark, d):
    words = vectors(spark, d).select(F.col("vec_id").cast("string").alias("word"), F.col("vec").alias("vector"))
    return word2vec.synonyms(words, [float(i) for i in range(64)], 10).select("word", F.round("similarity", 6).alias("similarity"))


@query()
def word2vec_train(spark, d):
    """One pass of CBOW with tree and negatives over the users' event sequences; rows only."""
    events = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    corpus = events.select(F.transform("e", lambda x: x["event_type"]).alias("tokens"))
    return word2vec.fit(corpus, word2vec.Config(vector_size=16, partitions=4, min_count=1, cbow=True, negative=2)).vectors


def _sizes(trained: DataFrame) -> DataFrame:
    return trained.select("word", F.size("vector").alias("size"), F.forall("vector", lambda x: F.abs(x) < float("inf")).alias("finite"))


@query(f"{_walk_sql(STEPS)} SELECT word, 16 AS size, true AS finite FROM (SELECT unnest(string_split(path, ' ')) AS word FROM w{STEPS}) GROUP BY 1")
def walk_embedding(spark, d):
    """Skip-gram with tree over the walks, so that the vocabulary grows with the graph. SQL tells the words; the vectors have to be finite."""
    paths = walk.random_walks(sp(spark, d).arcs(), WALKS, STEPS, SEED)
    corpus = paths.select(F.transform("path", lambda x: x.cast("string")).alias("tokens"))
    return _sizes(word2vec.fit(corpus, word2vec.Config(vector_size=16, partitions=8, min_count=1)).vectors)


@query(f"WITH {WORDS_SQL} SELECT word, 16 AS size, true AS finite FROM vocab")
def document_embedding(spark, d):
    """Skip-gram with tree over whole documents. SQL tells the words; the vectors have to be finite."""
    return _sizes(word2vec.fit(tokens(spark, d), word2vec.Config(vector_size=16, partitions=8, min_count=5)).vectors)


# link prediction

_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _edges(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("u"), (F.col("vec_id") + 1).alias("v"))


@query(f"SELECT a.vec_id AS u, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score {_NEXT}")
def edge_cosine(spark, d):
    return linkpred.edge_scores(_edges(spark, d), vectors(spark, d).select(F.col("vec_id").alias("node"), "vec")).select("u", "v", F.round("score", 6).alias("score"))


def _sp_pairs(spark, d):
    return sp(spark, d).edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))


_PLACE = "CAST('0x' || substr({}, 1, 12) AS BIGINT) % (SELECT count(*) FROM idx)"
_INDEX = "idx AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM (SELECT DISTINCT unnest([u, v]) AS node FROM e))"
#: Eight draws for each pair that is wanted are enough here.
_BY_PAIR = f"""
    WITH {SP_SQL}, e AS MATERIALIZED (SELECT src AS u, dst AS v FROM sp), {_INDEX},
    t AS (SELECT t, {_PLACE.format(f"md5('{SEED}:' || t || ':0')")} AS ka, {_PLACE.format(f"md5('{SEED}:' || t || ':1')")} AS kb FROM (SELECT unnest(range(8 * (SELECT count(*) FROM e))) AS t)),
    p AS (SELECT least(x.node, y.node) AS u, greatest(x.node, y.node) AS v, min(t) AS t FROM t JOIN idx x ON ka = x.k JOIN idx y ON kb = y.k WHERE ka <> kb GROUP BY 1, 2)
    SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY t) AS n FROM p ANTI JOIN e USING (u, v)) WHERE n <= (SELECT count(*) FROM e)"""
_BY_NODE = f"""{_INDEX},
    made AS (SELECT u, n, md5('{SEED}:' || u || ':' || t) AS h FROM (SELECT u, count(*) AS n, unnest(range(1, 2 * count(*) + 1)) AS t FROM e GROUP BY u)),
    drawn AS MATERIALIZED (SELECT u, n, h, {_PLACE.format("h")} AS k FROM made),
    first AS (SELECT u, node AS v, min(h) AS h, any_value(n) AS n FROM drawn JOIN idx USING (k) WHERE u <> node GROUP BY 1, 2),
    neg AS MATERIALIZED (SELECT u, v FROM (SELECT u, v, n, row_number() OVER (PARTITION BY u ORDER BY h, v) AS place FROM first ANTI JOIN e USING (u, v)) WHERE place <= n)"""


@query(_BY_PAIR)
def negatives_by_pair(spark, d):
    e = _sp_pairs(spark, d)
    return linkpred.negatives_by_pair(e, linkpred.node_list(e), 1.0, SEED)


@query(f"WITH {SP_SQL}, e AS MATERIALIZED (SELECT src AS u, dst AS v FROM sp), {_BY_NODE} SELECT u, v FROM neg")
def negatives_by_node(spark, d):
    return linkpred.negatives_by_node(_sp_pairs(spark, d), 1.0, SEED)


def _scored(spark, d):
    return table(spark, d, "orders").select(F.col("o_totalprice").alias("score"), F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("label"))


_SCORED = "s AS (SELECT o_totalprice AS score, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS label FROM orders), per AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1)"


@query(f"WITH {_SCORED}, r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM per) SELECT round(CAST(sum(p * low + p * n / 2) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE), 9) AS auc FROM r")
def auc_paircount(spark, d):
    return linkpred.auc(_scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score, label) AS k FROM s) SELECT round((sum(CASE WHEN label = 1 THEN k ELSE 0 END) - sum(label) * (sum(label) + 1) / 2)::DOUBLE / (sum(label) * sum(1 - label))::DOUBLE, 9) AS auc FROM r")
def auc_rank(spark, d):
    return linkpred.auc_by_order(_scored(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"""
    WITH e AS MATERIALIZED (SELECT vec_id AS u, vec_id + 1 AS v FROM embeddings), {_BY_NODE},
    s AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, x.label
          FROM (SELECT u, v, 1 AS label FROM e UNION ALL SELECT u, v, 0 FROM neg) x JOIN embeddings a ON u = a.vec_id JOIN embeddings b ON v = b.vec_id),
    per AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s WHERE NOT isnan(score) GROUP BY 1),
    r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM per)
    SELECT round(CAST(sum(p * low + p * n / 2) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auc FROM r""")
def link_prediction_auc(spark, d):
    found = linkpred.link_prediction(_edges(spark, d), vectors(spark, d).select(F.col("vec_id").alias("node"), "vec"), 1.0, SEED)
    return found.select(F.round("auc", 6).alias("auc"))


# dense vectors

_E = "(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"


@query(f"SELECT vec_id, round(sum(abs(x)), 6) AS n1, round(sqrt(sum(x * x)), 6) AS n2, round(sum(abs(x) ** 3) ** (1 / 3.0::DOUBLE), 6) AS n3, max(abs(x)) AS n_inf, count(*) FILTER (x <> 0) AS nnz FROM {_E} GROUP BY 1")
def vec_norms(spark, d):
    v = F.col("vec")
    return vectors(spark, d).select("vec_id", F.round(arrays.norm(v, 1), 6).alias("n1"), F.round(arrays.norm(v), 6).alias("n2"), F.round(arrays.norm(v, 3), 6).alias("n3"), arrays.norm(v, float("inf")).alias("n_inf"), arrays.nonzeros(v).alias("nnz"))


@query(f"SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS sqdist, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot {_NEXT}")
def vec_sqdist_dot(spark, d):
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("y"))
    return v.join(b, "vec_id").select("vec_id", F.round(arrays.squared_distance(F.col("vec"), F.col("y")), 6).alias("sqdist"), F.round(arrays.dot(F.col("vec"), F.col("y")), 6).alias("dot"))


@query(f"SELECT vec_id, arg_max(k, struct_pack(x := x, k := -k)) - 1 AS at, false AS sparse FROM {_E} GROUP BY 1")
def vec_argmax(spark, d):
    return vectors(spark, d).select("vec_id", arrays.argmax(F.col("vec")).alias("at"), arrays.is_sparse_smaller(F.col("vec")).alias("sparse"))


@query(f"SELECT vec_id, k - 1 AS k, 2 * x + 0.5::DOUBLE * x AS x FROM {_E}")
def vec_axpy(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", F.posexplode(arrays.axpy(2.0, F.col("vec"), arrays.scale(0.5, F.col("vec")))).alias("k", "x")).select("vec_id", F.col("k").cast("bigint").alias("k"), "x")


from . import job_queries, local_queries  # noqa: E402, F401  they add their queries to the tables above
