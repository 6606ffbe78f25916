"""Queries of what runs on the driver over small results: look-ups, local vectors and matrices, the trainer's tree, rate and gradient."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import algebra, local
from .operators import linkpred, matrix, partition, vector, word2vec
from .queries import AB_SQL, NN_SQL, SP_SQL, UV_SQL, a_b, named, nn, query, sp, table, u_w

_FULL = "FROM u FULL JOIN w ON u.idx = w.idx"
_IDX = "coalesce(u.idx, w.idx) AS idx"
for _name, _monoid, _sql in (
    ("vec_cooperate_second", algebra.Monoid(algebra.SECOND, 0.0), "coalesce(w.val, 0)"),
    ("vec_cooperate_times", algebra.TIMES_MONOID, "coalesce(u.val, 1) * coalesce(w.val, 1)"),
    ("vec_cooperate_plus", algebra.PLUS_MONOID, "coalesce(u.val, 0) + coalesce(w.val, 0)"),
):
    named(_name, lambda s, d, m=_monoid: vector.cooperate(*u_w(s, d), m), f"WITH {UV_SQL} SELECT {_IDX}, {_sql} AS val {_FULL}")


@query("SELECT * FROM (VALUES (1::BIGINT, 0.4::DOUBLE), (3, 12), (5, 3.5), (8, 1)) t(idx, val)")
def vec_from_entries(spark, d):
    return vector.from_entries(spark, 10, [(1, 0.4), (3, 12), (5, 3.5), (8, 1)])


@query("SELECT * FROM (VALUES ('repeated', true), ('negative', true), ('too large', true), ('no size', true), ('good', false)) t(name, refused)")
def vec_refusals(spark, d):
    cases = {"repeated": (10, [(1, 1.0), (1, 2.0)]), "negative": (10, [(-1, 1.0)]), "too large": (10, [(10, 1.0)]), "no size": (0, []), "good": (10, [(9, 1.0)])}

    def refused(size: int, entries: list) -> bool:
        try:
            local.sparse_vector(size, entries)
            vector.from_entries(spark, size, entries)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(*x)) for k, x in cases.items()], "name string, refused boolean")


@query(f"WITH {UV_SQL} SELECT idx, count(*) AS n FROM (SELECT idx FROM u UNION ALL SELECT idx FROM w) GROUP BY 1 HAVING count(*) > 1 OR idx >= 150")
def vec_violations(spark, d):
    u, w = u_w(spark, d)
    return vector.violations(u.unionByName(w), 150)


@query(f"WITH {UV_SQL} SELECT idx, idx + 2 * val AS val FROM u")
def vec_map_active(spark, d):
    return vector.map_active(u_w(spark, d)[0], lambda i, x: i + 2 * x)


@query(f"WITH {UV_SQL}, q AS (SELECT CAST(unnest(range(0, 60, 7)) AS BIGINT) AS idx) SELECT q.idx, coalesce(val, 0.0::DOUBLE) AS val FROM q LEFT JOIN u ON q.idx = u.idx")
def vec_lookup(spark, d):
    u = u_w(spark, d)[0].where("idx < 60").cache()
    out = spark.createDataFrame([(i, vector.lookup(u, i)) for i in range(0, 60, 7)], "idx bigint, val double")
    u.unpersist()
    return out


@query("SELECT * FROM (VALUES ('u', false), ('zeros', true), ('none', true)) t(name, empty)")
def vec_is_empty(spark, d):
    u = u_w(spark, d)[0]
    return spark.createDataFrame([("u", vector.is_empty(u)), ("zeros", vector.is_empty(vector.scale(u, 0.0))), ("none", vector.is_empty(u.limit(0)))], "name string, empty boolean")


@query(f"WITH {UV_SQL} SELECT idx, val FROM u WHERE idx < 100")
def vec_collected(spark, d):
    return spark.createDataFrame(vector.collect(u_w(spark, d)[0].where("idx < 100")), "idx bigint, val double")


@query(f"WITH {SP_SQL} SELECT DISTINCT src AS node FROM arcs")
def pair_nodes(spark, d):
    return linkpred.node_list(sp(spark, d).edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query("WITH a AS (SELECT * FROM (VALUES (0, 0), (1, 2), (2, 2), (3, 7), (4, 12)) t(k, x)), q AS (SELECT CAST(unnest(range(-1, 15)) AS BIGINT) AS x) SELECT q.x, CAST(coalesce(max(k), -1) AS BIGINT) AS at FROM q LEFT JOIN a ON a.x <= q.x GROUP BY 1")
def lower_bound_lookup(spark, d):
    return spark.createDataFrame([(x, partition.lower_bound([0, 2, 2, 7, 12], x)) for x in range(-1, 15)], "x bigint, at bigint")


@query(f"WITH {AB_SQL} SELECT count(DISTINCT i) AS n FROM a")
def mat_stored_rows(spark, d):
    return spark.createDataFrame([(matrix.stored_rows(a_b(spark, d)[0]),)], "n bigint")


# local matrices: of nations by nations

N = 25


def _local(spark: SparkSession, d: str):
    return local.from_coo(N, N, [(r.i, r.j, r.v) for r in nn(spark, d).collect()])


def _cells(spark: SparkSession, *named_matrices: tuple[str, object]) -> DataFrame:
    rows = [(name, int(i), int(j), float(x[i, j])) for name, m in named_matrices for x in [m.toArray()] for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "name string, i bigint, j bigint, v double")


def _parts(*parts: tuple[str, str]) -> str:
    return f"WITH {NN_SQL}, k AS (SELECT CAST(unnest(range({N})) AS BIGINT) AS i) " + " UNION ALL ".join(f"SELECT '{n}' AS name, i, j, CAST(v AS DOUBLE) AS v FROM ({q})" for n, q in parts)


@query(_parts(("local", "SELECT * FROM nn"), ("sparse", "SELECT * FROM nn"), ("transposed", "SELECT j AS i, i AS j, v FROM nn"), ("twice", "SELECT i, j, 2 * v AS v FROM nn")))
def local_matrix(spark, d):
    """Collected, in both forms, transposed, and mapped."""
    m = _local(spark, d)
    dense = local._dense(matrix.to_local(nn(spark, d), N, N))
    return _cells(spark, ("local", dense), ("sparse", local.to_sparse(dense)), ("transposed", local.transpose(m)), ("twice", local.mapped(m, lambda x: 2 * x)))


@query(_parts(("eye", "SELECT i, i AS j, 1 AS v FROM k"), ("speye", "SELECT i, i AS j, 1 AS v FROM k"), ("ones", "SELECT a.i, b.i AS j, 1 AS v FROM k a, k b"), ("diag", "SELECT i, i AS j, i AS v FROM k WHERE i > 0"), ("spdiag", "SELECT i, i AS j, i AS v FROM k WHERE i > 0")))
def local_factories(spark, d):
    v = DenseVector(range(N))
    return _cells(spark, ("eye", local.eye(N)), ("speye", local.speye(N)), ("ones", local.ones(N, N)), ("zeros", local.zeros(N, N)), ("diag", local.diag(v)), ("spdiag", local.spdiag(v)))


@query(_parts(("set", "SELECT i, j, CASE WHEN i = 3 AND j = 4 THEN -1 ELSE coalesce(v, 0) END AS v FROM (SELECT a.i, b.i AS j, v FROM k a CROSS JOIN k b LEFT JOIN nn ON nn.i = a.i AND nn.j = b.i) WHERE coalesce(v, 0) <> 0 OR (i = 3 AND j = 4)"), ("horz", f"SELECT * FROM nn UNION ALL SELECT i, j + {N} AS j, v FROM nn"), ("vert", f"SELECT * FROM nn UNION ALL SELECT i + {N} AS i, j, v FROM nn")))
def local_updates(spark, d):
    """One entry set, and matrices side by side."""
    m = _local(spark, d)
    dense = local._dense(m.toArray())
    return _cells(spark, ("set", local.updated(dense, 3, 4, -1.0)), ("horz", local.horzcat([m, dense])), ("vert", local.vertcat([m, m])))


@query(_parts(("gemm", "SELECT i, j, sum(v) AS v FROM (SELECT a.i, b.j, 2 * a.v * b.v AS v FROM nn a JOIN nn b ON a.j = b.i UNION ALL SELECT i, j, -v FROM nn) GROUP BY 1, 2 HAVING sum(v) <> 0"), ("gemv", "SELECT i, 0 AS j, sum(v) AS v FROM (SELECT i, 2 * v * j AS v FROM nn UNION ALL SELECT i, 3 * i FROM k) GROUP BY 1 HAVING sum(v) <> 0"), ("syr", "SELECT i, j, sum(v) AS v FROM (SELECT * FROM nn UNION ALL SELECT a.i, b.i, 0.5 * a.i * b.i FROM k a, k b) GROUP BY 1, 2 HAVING sum(v) <> 0")))
def local_products(spark, d):
    m, v = local._dense(_local(spark, d).toArray()), DenseVector(range(N))
    column = local._dense(local.gemv(2.0, m, v, 3.0, v).toArray()[:, None])
    return _cells(spark, ("gemm", local.gemm(2.0, m, m, -1.0, m)), ("gemv", column), ("syr", local.syr(0.5, v, m)))


@query(f"WITH {NN_SQL}, k AS (SELECT CAST(unnest(range({N})) AS BIGINT) AS i) SELECT k.i, coalesce(sum(v) FILTER (nn.i = k.i), 0.0::DOUBLE) AS row_sum, coalesce(sum(v) FILTER (nn.j = k.i), 0.0::DOUBLE) AS col_sum, count(*) FILTER (nn.i = k.i AND v <> 0) AS stored FROM k, nn GROUP BY 1")
def local_rows_and_columns(spark, d):
    m = _local(spark, d)
    rows, columns = local.rows(m), local.columns(m)
    return spark.createDataFrame([(i, float(rows[i].toArray().sum()), float(columns[i].toArray().sum()), local.count_active(local.compressed(rows[i]), nonzero=True)) for i in range(N)], "i bigint, row_sum double, col_sum double, stored bigint")


@query("SELECT * FROM (VALUES ('sparse and dense', true), ('another component', false), ('another size', false), ('stored zero', true), ('few stay sparse', true), ('many go dense', true), ('slice', true)) t(name, holds)")
def local_vectors(spark, d):
    """Equality whatever the form, the smaller form, and slices."""
    v = Vectors.sparse(10, [1, 3], [2.0, 5.0])
    checks = [
        ("sparse and dense", local.same(v, DenseVector(v.toArray()))), ("another component", local.same(v, Vectors.sparse(10, [1, 3], [2.0, 6.0]))),
        ("another size", local.same(v, Vectors.sparse(11, [1, 3], [2.0, 5.0]))), ("stored zero", local.same(v, Vectors.sparse(10, [1, 3, 4], [2.0, 5.0, 0.0]))),
        ("few stay sparse", local.compressed(DenseVector(v.toArray())) == v and hasattr(local.compressed(v), "indices")), ("many go dense", not hasattr(local.compressed(Vectors.sparse(3, [0, 1, 2], [1.0, 1.0, 1.0])), "indices")),
        ("slice", local.same(local.take(v, [3, 0, 1]), DenseVector([5.0, 0.0, 2.0]))),
    ]
    return spark.createDataFrame([(n, bool(x)) for n, x in checks], "name string, holds boolean")


# the trainer


@query("""
    WITH RECURSIVE c AS (SELECT p_type, count(*) AS cn FROM part GROUP BY 1),
    r AS (SELECT list_sort(list(cn)) AS l, CAST(0 AS BIGINT) AS bits FROM c UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM r WHERE len(l) > 1)
    SELECT (SELECT count(*) FROM c) AS n_words, CAST(max(bits) AS BIGINT) AS n_bits, 1.0::DOUBLE AS kraft FROM r""")
def huffman_cost(spark, d):
    """Bits of the whole text in the tree's codes, which is the least there is; the codes' shares of all codes, which is 1."""
    words = word2vec.vocabulary(table(spark, d, "part").select(F.array("p_type").alias("tokens")), 1)
    counts = [r.cn for r in words.orderBy("idx").collect()]
    codes, _ = word2vec.huffman(counts)
    return spark.createDataFrame([(len(counts), sum(n * len(c) for n, c in zip(counts, codes, strict=True)), sum(2.0 ** -len(c) for c in codes))], "n_words bigint, n_bits bigint, kraft double")


#: The counts of the tree below; the fifth word's path by hand: inner nodes from the root, and bits.
_COUNTS = [9, 7, 5, 3, 2, 1]
_PATH = "path AS (SELECT * FROM (VALUES (4, 0), (2, 1), (1, 0), (0, 1)) t(node, bit))"
_START = "syn AS (SELECT i AS node, k, ((7 * i + 3 * k) % 11 - 5) / 20.0::DOUBLE AS x FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(4)) AS k)), h AS (SELECT k, (k - 1.5::DOUBLE) / 4 AS h FROM (SELECT unnest(range(4)) AS k))"


def _start() -> tuple[np.ndarray, np.ndarray]:
    syn = np.array([[((7 * i + 3 * k) % 11 - 5) / 20 for k in range(4)] for i in range(6)], "f4")
    return syn, np.array([(k - 1.5) / 4 for k in range(4)], "f4")


def _after(spark: SparkSession, table: np.ndarray, grad: np.ndarray) -> DataFrame:
    rows = [(i, k, round(float(table[i, k]), 4)) for i in range(6) for k in range(4)] + [(-1, k, round(float(grad[k]), 4)) for k in range(4)]
    return spark.createDataFrame(rows, "node bigint, k bigint, x double")


@query(f"""
    WITH {_PATH}, {_START}, f AS (SELECT node, bit, sum(x * h) AS f FROM path JOIN syn USING (node) JOIN h USING (k) GROUP BY 1, 2),
    g AS (SELECT node, (1 - bit - 1 / (1 + exp(-f))) * 0.5::DOUBLE AS g FROM f)
    SELECT node, k, round(x + coalesce(g, 0) * h, 4) AS x FROM syn JOIN h USING (k) LEFT JOIN g USING (node) UNION ALL SELECT -1, k, round(sum(g * x), 4) FROM g JOIN syn USING (node) GROUP BY k""")
def hierarchical_step(spark, d):
    """One step of the hierarchical softmax: the inner nodes' weights after it, and (node -1) the gradient for the input."""
    syn, h = _start()
    codes, points = word2vec.huffman(_COUNTS)
    w = word2vec._Weights(np.zeros((6, 4), "f4"), syn, np.zeros((6, 4), "f4"))
    grad = w.learn(h, word2vec.Config(vector_size=4), 4, codes, points, None, 0.5)
    return _after(spark, syn, grad)


@query(f"""
    WITH {_START}, f AS (SELECT node, sum(x * h) AS f FROM syn JOIN h USING (k) WHERE node IN (4, 0, 2, 5) GROUP BY 1),
    g AS (SELECT node, (CAST(node = 4 AS INT) - 1 / (1 + exp(-f))) * 0.5::DOUBLE AS g FROM f)
    SELECT node, k, round(x + coalesce(g, 0) * h, 4) AS x FROM syn JOIN h USING (k) LEFT JOIN g USING (node) UNION ALL SELECT -1, k, round(sum(g * x), 4) FROM g JOIN syn USING (node) GROUP BY k""")
def negative_step(spark, d):
    """One step of negative sampling for word 4, with 0, 2 and 5 drawn, and 4 itself, which is no negative."""
    syn, h = _start()
    w = word2vec._Weights(np.zeros((6, 4), "f4"), np.zeros((6, 4), "f4"), syn)
    grad = w.learn(h, word2vec.Config(vector_size=4, hs=False, negative=4), 4, [], [], lambda n: np.array([0, 4, 2, 5]), 0.5)
    return _after(spark, syn, grad)


@query("SELECT CAST(s AS BIGINT) AS seen, round(greatest(0.025::DOUBLE * (1 - 4 * s / 10001.0::DOUBLE), 0.0000025::DOUBLE), 9) AS rate FROM (SELECT unnest(range(0, 3001, 250)) AS s)")
def learning_rate(spark, d):
    c = word2vec.Config(partitions=4)
    return spark.createDataFrame([(s, round(word2vec.rate(c, s, 10_000), 9)) for s in range(0, 3001, 250)], "seen bigint, rate double")
