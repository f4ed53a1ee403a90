import math

import numpy as np

from bitquarry.llm.ann import Graph, search


def brute(rows, every, top):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in good.items():
        if i % every == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in good.items() if j != i))[:top]
    return out


def test_search_recall_scores_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2020, [float("nan")] * 8), (2040, [1.0, None] * 4), (2060, [1.0] * 3), (2080, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "y")
    got = {}
    for r in search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    vec = dict(rows)
    found = total = 0
    for i, best in got.items():
        best.sort()
        assert [k for k, _, _ in best] == list(range(1, 21))
        assert [(s, j) for _, s, j in best] == sorted((s, j) for _, s, j in best)
        for _, s, j in best:
            assert abs(-s - float(np.dot(vec[i], vec[j]))) < 1e-12
        found += len({j for _, _, j in best} & {j for _, j in want[i]})
        total += 20
    assert found / total >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert search(df.limit(0)).count() == 0


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(200, 6))
    g = Graph(c)
    hit = 0
    for q in rng.normal(size=(50, 6)):
        a, d = g.search(q, 10)
        assert (np.diff(d) >= 0).all()
        hit += len(set(a.tolist()) & set(((c - q) ** 2).sum(1).argsort()[:10].tolist()))
    assert hit / 500 > 0.95
