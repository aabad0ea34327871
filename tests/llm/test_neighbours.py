import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import neighbours as N


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 8)) * rng.uniform(0.5, 3, (80, 1))
    x[40:60] = x[7]  # equal vectors
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [(100, None, ""), (200, [0.0] * 8, ""), (300, [1.0] * 7 + [None], ""), (400, [float("nan")] * 8, ""), (500, [float("inf")] * 8, ""), (600, [1.0] * 5, ""), (640, [2.0] * 5, ""), (None, [1.0] * 8, ""), (20, x[20].tolist(), "again")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = N.nearest(df, F.col("id") % 20 == 0, k=5).collect()
    want = brute(np.arange(80), x, [0, 20, 40, 60], 5)
    for q, best in want.items():
        mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert [i for i, _ in mine] == [i for i, _ in best]
        assert [s for _, s in mine] == pytest.approx([s for _, s in best], rel=1e-12)
    assert {r.query_id for r in got} == {*want, 600, 640}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 600] == [(640, 10.0)]  # a length of its own


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in N.nearest(df, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert N.nearest(df.limit(0), F.col("id") == 0).collect() == []
    assert N.nearest(df, F.col("id") == 9).collect() == []


def test_descent_and_search_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = N.nearest(df, F.col("id") % 50 == 0, k=10).collect()
    want = brute(np.arange(1500), x, range(0, 1500, 50), 10)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * 300 and len(got) == 300


def test_trees_split_evenly():
    sample = np.random.default_rng(0).normal(size=(4096, 10)).astype(np.float32)
    sizes = np.bincount(N.Trees.fit(sample, 4, 1).leaves(sample)[:, 0], minlength=16)
    assert sizes.min() > 200 and sizes.max() < 320


def recall(spark, x, k=20, step=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = N.nearest(df, F.col("id") % step == 0, k=k).collect()
    want = brute(np.arange(len(x)), x, range(0, len(x), step), k)
    return sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) / (k * len(want))


def test_clusters_larger_than_the_links_are_entered(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 64)), 50, 0) + 0.05 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x) >= 0.99


def test_neighbours_in_another_cluster_are_found(spark):
    """Each direction has a cluster of short and one of long vectors: the long ones are nearest to the short ones."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(20, 64)), 100, 0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.005 * rng.normal(size=x.shape)) * np.tile(np.repeat([0.3, 1.0], 50), 20)[:, None]
    assert recall(spark, x) >= 0.95


def test_plain_and_heavy_tailed_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24))
    assert recall(spark, x, step=40) >= 0.9
    assert recall(spark, x[:3000] * rng.lognormal(0, 1.2, (3000, 1)), step=40) >= 0.9


def test_descent_runs_on_a_small_table(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(N, "_neighbourhoods", lambda graph, own=N._neighbourhoods: rounds.append(1) or own(graph))
    assert recall(spark, np.random.default_rng(9).normal(size=(500, 16))) >= 0.95
    assert rounds


def test_vectors_that_share_half_a_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0], 7, i % 3) for i in range(3)], "id long, vec array<double>, node long, twin long")
    got = N._nearest(rows, F.col("id") == 0, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 4.0), (1, 3.0)]
