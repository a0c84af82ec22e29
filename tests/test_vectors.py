import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vector as V
from quern.functions.sqltypes import SqlError
from quern.operators import ann
from quern.operators.hnsw import Hnsw, Params
from quern.sources.vecs import read_vecs, write_vecs


def test_golden_distances(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id int, v array<float>")
    assert [r[0] for r in df.orderBy("id").select(V.l2(F.col("v"), [0, 0])).collect()] == [0.0, 5.0, None]
    assert df.where("id = 2").select(V.negative_inner(F.col("v"), [1, 2])).first()[0] == -11.0
    assert df.where("id = 2").select(V.cosine(F.col("v"), [3, 4])).first()[0] == pytest.approx(0.0, abs=1e-15)
    with pytest.raises(Exception, match="zero vector"):
        df.select(V.cosine(F.col("v"), [1, 0])).collect()


@pytest.mark.parametrize("value", ["[1]", "1,2", "[a,b]", "[nan,1]", [1.0], [math.inf, 0.0], 3])
def test_query_vectors_refused(value):
    with pytest.raises(SqlError):
        V.query_vector(value, 2, V.L2)


@pytest.mark.parametrize("metric", ["vector_l2_ops", "vector_cosine_ops", "vector_ip_ops"])
@pytest.mark.parametrize("heuristic", [True, False])
def test_graph_against_brute_force(metric, heuristic):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    g = Hnsw(metric, Params(ef_construction=60, heuristic=heuristic))
    for v in x:
        g.insert(v)
    q = rng.normal(size=8)
    q64 = q.astype(np.float32).astype(float)
    order = np.lexsort((np.arange(300), g.distances(q64, np.arange(300))))
    assert [n for n, _ in g.search(q, 10, 300)] == order[:10].tolist()  # a flooded search is exact
    a = g.audit()
    assert a["unreachable_live_count"] == 0 and a["node_count"] == 300
    for n in order[:5].tolist():
        g.delete(n)
        g.delete(n)
    assert [n for n, _ in g.search(q, 5, 300)] == order[5:10].tolist()
    assert g.redirect()["links_removed"] > 0
    assert [n for n, _ in g.search(q, 5, 300)] == order[5:10].tolist()


def test_graph_limits():
    g = Hnsw()
    assert g.search([1.0], 3) == []
    g.insert([1.0, 2.0])
    assert g.search([1.0, 2.0], 0) == []
    for bad in ([1.0], [math.nan, 0.0]):
        with pytest.raises(ValueError):
            g.insert(bad)
    with pytest.raises(ValueError):
        g.search([1.0, 2.0], 5, 4)
    with pytest.raises(ValueError):
        Hnsw("vector_cosine_ops").insert([0.0, 0.0])


@pytest.mark.parametrize("metric", ["vector_l2_ops", "vector_cosine_ops", "vector_ip_ops"])
def test_filled_graph_against_brute_force(metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[100:140] = x[5]  # copies
    g = Hnsw(metric)
    g.fill(x)
    assert len(g) == 700 and g.audit()["unreachable_live_count"] == 0
    hits = 0
    for q in rng.normal(size=(20, 12)):
        d = g.distances(g.check(q), np.arange(700))
        worst = np.sort(d)[9]
        hits += sum(d[n] <= worst + 1e-12 for n, _ in g.search(q, 10))
    assert hits >= 190
    g.insert(x[3])  # it can grow
    assert {n for n, _ in g.search(x[3], 2)} == {3, 700} or metric == "vector_ip_ops"
    empty = Hnsw(metric)
    empty.fill([])
    assert empty.search([1.0, 2.0], 3) == []
    with pytest.raises(ValueError):
        g.fill(x)


def test_shards_and_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "_tid long, v array<float>")
    path = str(tmp_path / "g")
    ann.build(df, "_tid", "v", "vector_l2_ops", path, Params(ef_construction=60))
    q = [x[i].tolist() for i in (3, 5)]
    hits = ann.search(spark, path, "vector_l2_ops", q, 5, ef=100).toPandas().sort_values(["query", "distance", "tid"])
    found = [hits[hits["query"] == i].tid.tolist()[:5] for i in (0, 1)]
    truth = [np.argsort(((x - v) ** 2).sum(1), kind="stable")[:5].tolist() for v in np.array(q, np.float32)]
    assert ann.recall_at_k(truth, found, 5, 400) >= 0.9
    report = ann.report(spark, path, df.where("_tid < 300"), "vector_l2_ops")
    assert report["node_count"] == 400 and report["tombstoned_count"] == 100 and report["rebuild_recommended"]


@pytest.mark.parametrize("truth, found, k", [([], [], 1), ([[1]], [[1]], 0), ([[1, 1]], [[1, 2]], 2), ([[1]], [[1, 2]], 2), ([[-1]], [[1]], 1), ([[1]], [[99]], 1)])
def test_recall_refuses(truth, found, k):
    with pytest.raises(ValueError):
        ann.recall_at_k(truth, found, k, 10)


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "i int, v array<float>").coalesce(1).orderBy("i")
    path = str(tmp_path / "x.fvecs")
    write_vecs(df, "v", path)
    assert [r.v for r in read_vecs(spark, path).orderBy("position").collect()] == [[1.0, 2.0], [3.0, 4.5]]
    with pytest.raises(Exception, match="budget"):
        read_vecs(spark, path, budget=3).collect()
    (tmp_path / "bad.ivecs").write_bytes(np.array([2, 1], "<i4").tobytes())
    with pytest.raises(Exception, match="doesn't fit"):
        read_vecs(spark, str(tmp_path / "bad.ivecs"), "ivecs").collect()


@pytest.mark.parametrize("metric", ["vector_l2_ops", "vector_cosine_ops", "vector_ip_ops"])
def test_exact_search_checks_what_the_graph_misses(metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    x[700:740] = x[9]  # more copies than are asked for
    g = Hnsw(metric)
    g.fill(x)
    g.delete(9)
    missed = 0
    for q in [*rng.normal(size=(20, 48)), x[9]]:
        d = g.distances(g.check(q), np.arange(1500))
        d = np.sqrt(d) if metric == "vector_l2_ops" else d
        d[9] = np.inf
        truth = [n for n in np.lexsort((np.arange(1500), d)) if d[n] <= np.sort(d)[9] + 1e-9]
        assert [n for n, _ in g.within(q, 10, 1e-9, 12)] == truth
        missed += [n for n, _ in g.search(q, 10, 12)] != truth
    assert missed  # the graph alone
    for n in range(1495):
        g.delete(n)
    assert {n for n, _ in g.within(x[3], 10, 0.0)} == set(range(1495, 1500))


def test_topk_of_copies_as_its_sql(spark, tmp_path):
    """Copies under ids that fall while row ids rise: ties at the limit go to the smaller vec_id."""
    from quern.plans import vector_queries

    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 64)).astype(np.float32)
    rows = [(i, x[i % 20].tolist(), 0) for i in range(399, -1, -1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("ann_topk", "ann_after_changes"):
        got = sorted(r.vec_id for r in vector_queries.queries()[name](spark, str(tmp_path)).collect())
        copies = [i for i in range(400) if i % 20 == 7]
        assert got == (copies[:10] if name == "ann_topk" else sorted([11, *copies[1:10]]))


def test_vector_files_of_many_tasks(spark, tmp_path, monkeypatch):
    """Written where spark.checkpoint.dir points, a URI as on a cluster: positions go on over all files."""
    from quern.plans import vector_queries
    from quern.sources import vecs

    monkeypatch.setattr(vecs, "FILE_BYTES", 40_000)
    monkeypatch.setattr(vector_queries, "scratch", lambda spark: f"file://{tmp_path}/shared/quern")
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, x[i].tolist(), 0) for i in rng.permutation(900).tolist()], "vec_id long, embedding array<float>, label int")
    rows.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r.position, r.total) for r in vector_queries.queries()["fvecs_round_trip"](spark, str(tmp_path)).collect())
    assert [p for p, _ in got] == list(range(900))
    assert np.allclose([t for _, t in got], x.astype(float).sum(1), atol=1e-5)
    with pytest.raises(ValueError, match="already"):
        write_vecs(rows, "embedding", f"{tmp_path}/shared/quern/vectors.fvecs")
    many = rows.orderBy("vec_id").repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id")
    write_vecs(many, "embedding", f"{tmp_path}/many")
    found = read_vecs(spark, f"{tmp_path}/many").orderBy("position").collect()
    assert len({r.path for r in found}) == 5 and np.array_equal(np.array([r.v for r in found], np.float32), x)
