import hashlib
import math

import numpy as np
import pyarrow as pa

from bitquarry.llm import elkan
from bitquarry.llm.elkan import Centroids, assign, cluster, digest, squares, vectors_of


def brute(rows, k, rounds, dims):
    """Every vector against every centroid in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    at = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i is None, i or 0), near(v)[1], near(v)[0]) for i, v in kept), [tuple(c) for c in at]


def check(spark, rows, k, rounds, dims):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS distance", "array(1) AS v")
    out, at, inertia = cluster(df.repartition(3), k, rounds, dims)
    got = out.collect()
    want, centroids = brute(rows, k, rounds, dims)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got) == want
    assert [tuple(c) for c in at.tolist()] == centroids
    for j, total in enumerate(inertia):
        assert total == sum(d for _, c, d in want if c == j)
    return got


def test_clusters_equal_brute_force_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-6, 7, 5) / 16).tolist()) for i in range(300)]  # a coarse grid: many equal distances
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [rows[11]] * 30 + [(None, [0.1] * 5), (None, [0.5] * 5)]
    rows += [(900, None), (901, [0.0] * 4), (902, [0.0] * 6), (903, [float("nan")] + [0.0] * 4), (904, [None] + [0.0] * 4), (905, [float("-inf")] + [0.0] * 4), (906, [])]
    check(spark, rows, 16, 3, 5)
    check(spark, rows, 4, 6, 5)


def test_few_equal_and_no_vectors(spark):
    check(spark, [(1, [0.25, -0.3]), (2, [0.25, -0.3]), (3, [-1.0, 2.0])], 16, 3, 2)
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    out, at, inertia = cluster(df, 16, 3, 64)
    assert out.columns == ["vec_id", "v", "cluster", "distance"] and out.count() == 0 and len(at) == len(inertia) == 0


def test_bounds_save_work_and_hold():
    rng = np.random.default_rng(4)
    middles = rng.integers(-40, 41, (8, 16))
    x = (middles[rng.integers(0, 8, 4000)] + rng.integers(-3, 4, (4000, 16))).astype(np.int64)
    at, moved = x[:8].copy(), np.zeros(8)
    own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), 8), np.float32)
    work = []
    for _ in range(5):
        own, exact, upper, lower, looked = assign(x, Centroids(at, moved), own, upper, lower)
        every = np.array([squares(x, c) for c in at]).T
        assert (every.argmin(1) == own).all() and (every.min(1) == exact).all()
        assert (lower <= np.sqrt(every)).all() and (upper >= np.sqrt(exact)).all()
        work.append(looked)
        mean = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else at[j] for j in range(8)])
        moved, at = np.sqrt(squares(mean, at).astype(float)) * (1 + 1e-7), mean
    assert work[-1] < 0.5 * 7 * len(x)


def test_large_components_are_exact():
    x = np.array([[2**27, -(2**27)], [2**27 - 1, 1]], np.int64)
    assert squares(x, np.array([-(2**27), 2**27])).tolist() == [2**57, (2**28 - 1) ** 2 + (2**27 - 1) ** 2]
    rows, v = vectors_of(pa.array([[2.0**21, 0.0], [2.0**21 + 1, 0.0], [-0.001, 0.999]]), 2)
    assert rows.tolist() == [0, 2] and v.tolist() == [[2**27, 0], [-1, 63]]


def test_query_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = elkan.op11_clusters(spark, str(tmp_path)).collect()
    want, centroids = brute([(i, v) for i, v, _ in rows], 16, 3, 64)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == [(i, c, d) for (_, i), c, d in want]
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == digest(np.array(centroids[r.cluster])) for r in got)
