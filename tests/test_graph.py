import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.functions import algebra, arrays, local
from lattica.operators import closed, linkpred, matrix, partition, vector, walk, word2vec
from lattica.operators.graph import Graph
from lattica.params import parse
from lattica.plans.lineage import with_row_index
from lattica.sources import text

U = [(1, 0.4), (3, 12.0), (5, 3.5), (8, 1.0)]
V = [(2, 4.0), (3, 1.3), (7, 0.0), (8, 1.0)]


@pytest.fixture(scope="module")
def uv(spark):
    return vector.from_entries(spark, 10, U), vector.from_entries(spark, 10, V)


@pytest.fixture(scope="module")
def toy(spark):
    return Graph(spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)], "src bigint, dst bigint"))


def entries(df):
    return {r.idx: pytest.approx(r.val) for r in df.collect()}


def cells(df):
    return {(r.i, r.j): r.v for r in df.collect()}


@pytest.mark.parametrize(
    ("fn", "want"),
    [
        (vector.add, {1: 0.4, 2: 4, 3: 13.3, 5: 3.5, 8: 2}),
        (vector.multiply_union, {1: 0.4, 2: 4, 3: 15.6, 5: 3.5, 8: 1}),
        (vector.multiply_intersect, {3: 15.6, 8: 1}),
        (vector.multiply_zero_filled, {1: 0, 2: 0, 3: 15.6, 5: 0, 7: 0, 8: 1}),
        (vector.divide, {3: 12 / 1.3, 8: 1}),
        (vector.divide_zero_filled, {1: 0, 2: 0, 3: 12 / 1.3, 5: 0, 7: 0, 8: 1}),
        (lambda a, b: vector.scale(a, 10.0), {1: 4, 3: 120, 5: 35, 8: 10}),
        (lambda a, b: vector.scale(a, 10.0, algebra.MIN), {1: 0.4, 3: 10, 5: 3.5, 8: 1}),
        (lambda a, b: vector.cooperate(a, b, algebra.MIN_MONOID), {1: 0.4, 2: 4, 3: 1.3, 5: 3.5, 7: 0, 8: 1}),
        (lambda a, b: vector.densify(vector.mask(a, b), 10), {i: {3: 12, 8: 1}.get(i, 0) for i in range(10)}),
    ],
)
def test_vector_pairs(uv, fn, want):
    assert entries(fn(*uv)) == want


def test_vector_lookup_mask_and_checks(spark, uv):
    u, v = uv
    three = vector.from_entries(spark, 10, [(3, 1.0)])
    assert vector.lookup(u, 3) == 12 and vector.lookup(u, 4) == 0
    assert entries(vector.mask(u, three)) == {3: 12} and entries(vector.mask(u, three, True)) == {1: 0.4, 5: 3.5, 8: 1}
    assert vector.is_empty(vector.mask(v, vector.from_entries(spark, 10, [(7, 1.0)]))) and not vector.is_empty(u)
    assert vector.violations(u.unionByName(three), 9).collect() == [(3, 2)]
    assert vector.collect(vector.random(spark, 50, 1)) == vector.collect(vector.random(spark, 50, 1))
    assert all(0 <= x < 1 for _, x in vector.collect(vector.random(spark, 50, 1)))
    with pytest.raises(ValueError):
        vector.from_entries(spark, 3, [(3, 1.0)])


def test_semirings_and_ieee_division(spark):
    one = spark.createDataFrame([(1.25, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in one.select(algebra.DIVIDE(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and np.isnan(got[2]) and got[3] == 2
    assert one.limit(1).select(algebra.MAXFRAC(F.lit(1.5), F.lit(7.5))).head()[0] == 1.5
    m = spark.createDataFrame([(0, 0, 2.0), (1, 0, 0.5), (1, 1, 3.0)], "i bigint, j bigint, v double")
    v = vector.from_entries(spark, 2, [(0, 1.0), (1, 4.0)])
    want = {"plus_mul": {0: 4, 1: 12}, "plus_min": {0: 1.5, 1: 3}, "min_mul": {0: 2, 1: 12}, "min_plus": {0: 3, 1: 7}, "maxfrac_plus": {0: 4.5, 1: 7}}
    for name, w in want.items():
        assert entries(vector.vxm(v, m, algebra.SEMIRINGS[name])) == w
    own = algebra.Semiring(algebra.Monoid(algebra.PLUS, 0.0), algebra.TIMES)  # a monoid without an aggregate of its own
    assert entries(vector.vxm(v, m, own)) == want["plus_mul"]


def test_matrix_against_numpy(spark):
    g = np.random.default_rng(3)
    a, b = ((g.random((4, 5)) < 0.5) * g.integers(1, 9, (4, 5)).astype(float) for _ in range(2))
    df = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i bigint, j bigint, v double")
    at = lambda d, m=4, n=5: matrix.to_local(d, m, n)
    x, y = df(a), df(b)
    assert (at(matrix.add(x, y)) == a + b).all() and (at(matrix.subtract(x, y)) == a - b).all()
    assert (at(matrix.hadamard(x, y)) == a * b).all()
    assert (at(matrix.transpose(x), 5, 4) == a.T).all()
    assert (at(matrix.multiply(x, matrix.transpose(y)), 4, 4) == a @ b.T).all()
    assert (at(matrix.transpose(matrix.multiply(x, matrix.transpose(y))), 4, 4) == b @ a.T).all()
    assert (at(matrix.gemm(2, x, matrix.transpose(y), -1, matrix.multiply(y, matrix.transpose(x))), 4, 4) == 2 * a @ b.T - b @ a.T).all()
    assert (at(matrix.horzcat(x, y, 5), 4, 10) == np.hstack([a, b])).all() and (at(matrix.vertcat(x, y, 4), 8, 5) == np.vstack([a, b])).all()
    masked, rest = matrix.mask(x, y), matrix.mask(x, y, True)
    assert (at(masked.unionByName(rest)) == a).all() and not set(cells(masked)) & set(cells(rest))
    assert matrix.violations(x, 4, 5).isEmpty() and not matrix.violations(x.unionByName(x), 4, 5).isEmpty()
    assert cells(matrix.from_coo(x.unionByName(x))) == {k: 2 * v for k, v in cells(x).items()}
    v = vector.from_entries(spark, 5, [(i, float(i)) for i in range(5)])
    got = dict(vector.collect(matrix.gemv(1.0, x, v, 1.0, vector.from_entries(spark, 4, [(0, 7.0)]))))
    assert all(got.get(i, 0) == w for i, w in enumerate(a @ np.arange(5.0) + [7, 0, 0, 0]))
    assert (at(matrix.rank_one(2.0, v, x.limit(0)), 5, 5) == 2 * np.outer(np.arange(5.0), np.arange(5.0))).all()


def test_graph_views(toy, spark):
    assert toy.num_edges() == 5
    assert {r.node: r.degree for r in toy.degrees().collect()} == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1}
    assert {r.node: r.nbrs for r in toy.neighbors().collect()}[2] == [0, 1, 3]
    loops = Graph(spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "src bigint, dst bigint, weight double"))
    assert [tuple(x) for x in {r.src: r.adj for r in loops.adjacency().collect()}[1]] == [(1, 2.0), (1, 2.0), (2, 1.0)]
    directed = Graph(loops.edges, directed=True)
    assert directed.degrees().count() == 1 and directed.nodes().count() == 2
    ids = spark.createDataFrame([(1, 0)], "node bigint, id bigint")
    assert cells(directed.to_matrix(ids)) == {(0, 0): 1.0}
    with pytest.raises(Exception, match="no id"):
        directed.to_matrix(ids, strict=True).collect()


def test_partitioners(toy, spark):
    ldg = partition.ldg_partition(toy, 2)
    assert {r.node: r.part for r in ldg.collect()} == {0: 0, 1: 0, 4: 0, 2: 1, 3: 1}
    lpt = partition.lpt_partition(toy.degrees(), 2)
    assert {r.node: r.part for r in lpt.collect()} == {2: 0, 3: 0, 0: 1, 1: 1, 4: 1}
    for a in (ldg, lpt):
        assert partition.edge_cut(toy, a).head().n_cut == 3
    ids = {r.node: r.id for r in partition.relabel(ldg).collect()}
    assert ids == {0: 0, 1: 1, 4: 2, 2: 3, 3: 4}
    starts = partition.thresholds(ldg, 3)
    assert {r.part: r.start for r in starts.collect()} == {0: 0, 1: 3, 2: 5}
    assert [partition.lower_bound([0, 2, 4, 6, 8, 10, 12, 14], x) for x in (-1, 0, 1, 2, 13, 16)] == [-1, 0, 0, 1, 6, 7]


def test_lpt_against_the_loop(spark):
    g = np.random.default_rng(5)
    degree = np.minimum(g.zipf(1.5, 400), 300)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(degree)], "node bigint, degree bigint")
    loads, want = [0] * 7, {}
    for i in sorted(range(400), key=lambda i: (-degree[i], i)):
        p = loads.index(min(loads))
        want[i] = p
        loads[p] += int(degree[i])
    assert {r.node: r.part for r in partition.lpt_partition(df, 7).collect()} == want


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    got = sorted((r.row_index, r.a, r.id) for r in with_row_index(df, F.desc("a"), F.asc("id")).collect())
    assert [x[0] for x in got] == list(range(1000)) and [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (-x[0], x[1]))
    assert with_row_index(df.limit(0), F.asc("id")).count() == 0


def test_walks_follow_edges_and_coalesce(toy, spark):
    arcs = toy.arcs()
    edges = {(r.src, r.dst) for r in arcs.collect()}
    paths = walk.random_walks(arcs, 3, 6, seed=1).collect()
    assert len(paths) == 15
    for r in paths:
        assert r.path[0] == r.src and len(r.path) == 7 and all(e in edges for e in zip(r.path, r.path[1:], strict=False))
    for w in range(3):
        for k in range(6):
            hops = {(r.path[k], r.path[k + 1]) for r in paths if r.walk == w}
            assert len({a for a, _ in hops}) == len(hops)
    sink = spark.createDataFrame([(0, 1, 1.0)], "src bigint, dst bigint, weight double")
    assert [r.path for r in walk.random_walks(sink, 1, 1).collect()] == [[1, 0]]
    assert sorted(r.path for r in walk.random_walks(sink, 1, 1, keep_stuck=True).collect()) == [[0], [1, 0]]
    assert all(e in edges for r in walk.weighted_walks(arcs, 2, 4).collect() for e in zip(r.path, r.path[1:], strict=False))
    # paths that were cut off in pieces on the way are whole again, and dropped walks stay dropped
    chain = spark.createDataFrame([(k + 1, k) for k in range(8)], "src bigint, dst bigint").withColumn("weight", F.lit(1.0))
    for rows, make in ((arcs, walk.random_walks), (arcs, walk.weighted_walks), (chain, walk.random_walks), (chain, walk.weighted_walks)):
        whole, pieces = (sorted(map(tuple, make(rows, 2, 7, cut_every=c).collect())) for c in (7, 2))
        assert whole == pieces and whole and all(len(r[2]) == 8 for r in whole)
    stuck = [sorted(map(tuple, walk.random_walks(chain, 1, 7, keep_stuck=True, cut_every=c).collect())) for c in (7, 3)]
    assert stuck[0] == stuck[1] and {len(r[2]) for r in stuck[0]} == set(range(1, 9))


def test_link_prediction(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.55, 0), (0.3, 0)]
    s = spark.createDataFrame(rows, "score double, label int")
    assert linkpred.auc(s).head()[0] == pytest.approx(8 / 9) and linkpred.auc_by_order(s).head()[0] == pytest.approx(8 / 9)
    assert linkpred.auc(s.withColumn("score", -F.col("score"))).head()[0] == pytest.approx(1 / 9)
    assert linkpred.auc(s.withColumn("score", F.lit(1.0))).head()[0] == pytest.approx(0.5)
    e = spark.createDataFrame([(i, (i * 7 + 1) % 30) for i in range(30)], "u bigint, v bigint")
    known = {(r.u, r.v) for r in e.collect()}
    by_node = [(r.u, r.v) for r in linkpred.negatives_by_node(e, 1.0).collect()]
    assert by_node and not known & set(by_node) and len(set(by_node)) == len(by_node)
    by_pair = [(r.u, r.v) for r in linkpred.negatives_by_pair(e, linkpred.node_list(e), 1.0).collect()]
    assert len(by_pair) == 30 and not {tuple(sorted(x)) for x in known} & set(by_pair)
    full = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "u bigint, v bigint")
    assert linkpred.negatives_by_pair(full, linkpred.node_list(full), 2.0).isEmpty()
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "node bigint, vec array<double>")
    assert [(r.u, r.v, round(r.score, 6)) for r in linkpred.edge_scores(full, vec).collect()] == [(0, 1, 0.707107)]


def test_word2vec(spark, tmp_path):
    assert word2vec.huffman([5, 3, 2, 1])[0] == [[0], [1, 1], [1, 0, 1], [1, 0, 0]]
    rows = [(["a", "b"] * 8 + ["c", "d"] * 8,) for _ in range(60)] + [([],), (None,)]
    t = spark.createDataFrame(rows, "tokens array<string>")
    for cbow, hs, negative in ((False, True, 0), (True, False, 3), (False, False, 2), (True, True, 0)):
        m = word2vec.fit(t, word2vec.Config(vector_size=8, partitions=2, iterations=2, window=2, min_count=1, cbow=cbow, hs=hs, negative=negative, learning_rate=0.1))
        v = {r.word: np.array(r.vector) for r in m.vectors.collect()}
        assert sorted(v) == ["a", "b", "c", "d"] and all(np.isfinite(x).all() for x in v.values())
    assert m.find_synonyms("a", 1).head().word == "a" and m.find_synonyms("a", 4, exclude_self=True).count() == 3
    with pytest.raises(KeyError):
        m.transform("x")
    m.save(str(tmp_path / "m"))
    again = word2vec.Model.load(spark, str(tmp_path / "m"))
    assert again.transform("b") == m.transform("b")
    docs = spark.createDataFrame([(1, ["a", "x"]), (2, [])], "id bigint, tokens array<string>")
    got = {r.id: r.vector for r in m.transform_documents(docs, "id", "tokens").collect()}
    assert np.allclose(got[1], v["a"] / 2) and got[2] == [0.0] * 8
    with pytest.raises(ValueError):
        word2vec.Config(hs=False)
    with pytest.raises(ValueError):
        word2vec.fit(t, word2vec.Config(min_count=10**6))


def test_sources(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 0.5\n3 4\n5 6 x\n")
    assert [tuple(r) for r in text.read_edges(spark, str(tmp_path / "e")).collect()] == [(1, 2, 0.5), (3, 4, 4.0), (5, 6, 1.0)]
    assert text.read_edges(spark, str(tmp_path / "e"), weighted=False).columns == ["src", "dst"]
    (tmp_path / "v").write_text("7 1.5 -2\n")
    assert text.read_embeddings(spark, str(tmp_path / "v")).collect() == [(7, [1.5, -2.0])]
    assert text.read_pairs(spark, str(tmp_path / "e")).count() == 6
    walks = spark.createDataFrame([([1, 2, 3],)], "path array<bigint>")
    text.write_walks(walks, str(tmp_path / "w"), 2)
    text.write_walks(walks, None, 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["1 2 3"]
    assert text.read_corpus(spark, str(tmp_path / "w"), 2).collect() == [(["1", "2", "3"],)]


def test_params_and_arrays(spark):
    p = parse(["--cmd", "partition", "--input", "x", "--output", "y", "--weighted", "false"])
    assert (p.dim, p.walkLength, p.partitioner, p.weighted) == (128, 80, "lpt", False)
    with pytest.raises(SystemExit):
        parse(["--cmd", "nothing", "--input", "x", "--output", "y"])
    df = spark.createDataFrame([([3.0, -4.0, 0.0],), ([],)], "a array<double>")
    got = df.select(arrays.norm(F.col("a")), arrays.norm(F.col("a"), 1), arrays.norm(F.col("a"), float("inf")), arrays.argmax(F.col("a")), arrays.nonzeros(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(5.0, 7.0, 4.0, 0, 2), (0.0, 0.0, 0.0, -1, 0)]


def test_local_linalg():
    v = local.sparse_vector(10, [(3, 2.0), (1, 1.0)])
    assert type(local.compressed(v)).__name__ == "SparseVector" and local.same(v, local.compressed(v))
    assert local.take(v, [3, 0]).toArray().tolist() == [2.0, 0.0]
    m = local.from_coo(2, 3, [(0, 1, 1.0), (0, 1, 2.0), (1, 2, 0.0)])
    assert m.toArray().tolist() == [[0, 3, 0], [0, 0, 0]] and local.transpose(m).toArray().shape == (3, 2)
    assert local.horzcat([m, local.speye(2)]).toArray().tolist() == [[0, 3, 0, 1, 0], [0, 0, 0, 0, 1]]
    assert local.gemm(2.0, local.eye(2), local.ones(2, 2), 1.0, local.eye(2)).toArray().tolist() == [[3, 2], [2, 3]]
    assert np.count_nonzero(local.sprand(10, 10, 0.2, 1).toArray()) == 20
    assert local.spr(1.0, local.sparse_vector(2, [(0, 1.0), (1, 2.0)]), np.zeros(3)).tolist() == [1, 2, 4]
    with pytest.raises(ValueError):
        local.from_coo(1, 1, [(1, 0, 1.0)])


def test_fold_without_an_aggregate(spark):
    """A monoid of the user's own gives what its built-in twin gives, though a hot group is folded in buckets."""
    longest = algebra.Monoid(algebra.MAX, -1e300)
    a = spark.range(3000).select(F.lit(0).cast("bigint").alias("i"), F.col("id").alias("j"), F.pmod(F.col("id") * 7919, F.lit(3001)).cast("double").alias("v"))
    b = spark.range(3000).select(F.col("id").alias("i"), F.pmod("id", F.lit(2)).alias("j"), F.lit(2.0).alias("v"))
    own, built_in = (sorted(map(tuple, matrix.multiply(a, b, algebra.Semiring(m, algebra.PLUS)).collect())) for m in (longest, algebra.MAX_MONOID))
    assert own == built_in and len(own) == 2
    v = a.select(F.col("j").alias("idx"), F.col("v").alias("val"))
    assert sorted(map(tuple, vector.vxm(v, b, algebra.Semiring(longest, algebra.PLUS)).collect())) == [(j, x) for _, j, x in built_in]


def test_trainer_parts_topics(spark):
    """Words of one topic are each other's nearest, with either output and either input."""
    rng = np.random.default_rng(1)
    t = spark.createDataFrame([([f"{topic}_{w}" for w in rng.integers(8, size=20)],) for topic in rng.integers(6, size=600)], "tokens array<string>")
    for cbow, hs, negative in ((False, True, 0), (False, False, 5), (True, True, 0)):
        m = word2vec.fit(t, word2vec.Config(vector_size=16, partitions=2, iterations=3, min_count=1, learning_rate=0.05, cbow=cbow, hs=hs, negative=negative))
        v = {r.word: np.array(r.vector) for r in m.vectors.collect()}
        words = sorted(v)
        x = np.array([v[w] / np.linalg.norm(v[w]) for w in words])
        near = np.argsort(x @ x.T - 9 * np.eye(len(x)), 1)[:, -3:]
        assert np.mean([words[i][0] == words[j][0] for i in range(len(words)) for j in near[i]]) > 0.9


def test_negatives_of_a_hub(spark):
    """A hub's negatives are the first of its own draws, none of them a neighbour."""
    e = spark.range(1, 400).select(F.lit(0).cast("bigint").alias("u"), "id").toDF("u", "v").unionAll(spark.range(400, 900).select("id", F.col("id") + 1).toDF("u", "v"))
    per = {}
    for r in linkpred.negatives_by_node(e, 0.5).collect():
        per.setdefault(r.u, set()).add(r.v)
    assert len(per[0]) == 199 and all(400 <= v <= 900 for v in per[0])
    assert all(len(x) <= 1 for u, x in per.items() if u)


def test_closed_paths(spark):
    """Counts against brute force, with hubs, loops, duplicates and far ids, and with rows cut over units and blocks and right rows over chunks."""
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(-20, 20, (500, 2))] + [(0, x) for x in range(-40, 200)] + [(x, 0) for x in range(-40, 200)]
    e += [(2**62, 0), (0, 2**62), (-(2**62), 2**62), (-(2**62), 0)]
    out = {}
    for i, j in e:
        out.setdefault(i, set()).add(j)
    want = {(i, j): n for i in out for j in out[i] if (n := sum(j in out.get(k, ()) for k in out[i]))}
    df = spark.createDataFrame(e, "i bigint, j bigint")
    for sizes in ((), (7, 11, 13, 1), (1 << 18, 1 << 21, 64, 4)):
        rows = closed.closed_paths(df, *sizes).collect()
        assert len(rows) == len(want) and {(r.i, r.j): r.v for r in rows} == want
    assert closed.closed_paths(df.limit(0)).isEmpty()
    near = {x: {b if a == x else a for a, b in e if x in (a, b)} - {x} for x in out}
    assert matrix.triangles(df).head().triangles == sum(len(near[a] & near[b]) for a in near for b in near[a]) // 6
    assert matrix.triangles(df.limit(0)).head().triangles == 0


def _nodes(plan):
    """The plan that ran, stages included."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        yield from _nodes(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        return
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


@pytest.mark.parametrize("name", ["triangle_count", "masked_spgemm"])
def test_paths_are_no_rows(spark, tmp_path, name):
    """With 7,140 pairs and 280,840 paths through them, no operator makes more rows than twice the pairs."""
    n = 120
    spark.createDataFrame([(o, p) for o in range(2) for p in range(n)], "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    made = [m.apply("numOutputRows").value() for x in _nodes(df._jdf.queryExecution().executedPlan()) if (m := x.metrics()).contains("numOutputRows")]
    assert made and max(made) <= n * (n - 1)
    paths = n * (n - 1) * (n - 2) // 6
    assert [tuple(r) for r in got] == [(paths,)] if name == "triangle_count" else (len(got), sum(r.v for r in got)) == ((n - 1) * (n - 2) // 2, paths)


def test_tree_alone_steps_as_any_window(monkeypatch):
    """Skip-gram with a tree alone, in its few calls, gives learn()'s tables, rows that were changed and draws, with words twice in a window and far values."""
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(5, 500, 60))[::-1].copy()
    sentences = [rng.integers(60, size=n).tolist() for n in (0, 1, 2, 40, 300)]
    codes, points = word2vec.huffman_paths(counts)
    for scale in (0.1, 4.0):  # products beyond 6 have no gradient
        c, start, calls = word2vec.Config(vector_size=8, sample=0.01), rng.normal(0, scale, (2, 60, 8)).astype("f4"), []
        want, got = (word2vec._Weights(*start.copy(), np.zeros((0, 8), "f4")) for _ in range(2))
        monkeypatch.setattr(word2vec._Weights, "learn", lambda *a, learn=word2vec._Weights.learn: calls.append(1) or learn(*a))
        draws, total = np.random.default_rng(2), int(counts.sum())
        ratio, seen = counts / (c.sample * total), 0
        for own in sentences:
            seen += len(own)
            s = np.array(own, "i4")
            s = s[np.sqrt(ratio[s] + 1) / ratio[s] >= draws.random(len(s))]
            reaches = c.window - draws.integers(c.window, size=len(s))
            for i, r in enumerate(reaches.tolist()):
                near = np.concatenate((s[max(0, i - r) : i], s[i + 1 : i + 1 + r]))
                if len(near):
                    np.add.at(want.syn0, near, want.learn(want.syn0[near], c, s[i], codes, points, None, word2vec.rate(c, seen, total)))
                    want.touched[0][near] = True
        stepped = len(calls)
        word2vec._train(iter(sentences), got, c, counts, codes, points, np.random.default_rng(2))
        assert stepped and len(calls) == stepped  # no call of learn() for a window
        assert np.allclose(got.syn0, want.syn0, atol=1e-4) and np.allclose(got.syn1, want.syn1, atol=1e-4) and not np.allclose(got.syn1, start[1])
        assert all((a == b).all() for a, b in zip(got.touched, want.touched, strict=True))
        monkeypatch.undo()


def test_tree_of_a_large_vocabulary():
    """The paths are a prefix code of least cost, against a plain heap."""
    counts = np.sort(np.random.default_rng(4).zipf(1.3, 3000).clip(max=10**6))[::-1].copy()
    codes, points = word2vec.huffman_paths(counts)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, two := heapq.heappop(heap) + heapq.heappop(heap))
        cost += two
    size = np.diff(codes.begin)
    assert (size * counts).sum() == cost and abs((0.5**size).sum() - 1) < 1e-9 and (points.flat[points.begin[:-1]] == len(counts) - 2).all()
    assert len({bytes(codes[k]) for k in range(len(counts))}) == len(counts)
