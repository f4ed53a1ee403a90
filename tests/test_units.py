"""Functions, generators, metrics and baselines against plain Python."""

import math
import random
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.functions import text as T
from bitquarry.operators import baselines, metrics, mining
from bitquarry.sources import generators as G
from bitquarry.sources import records as R


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_lgamma_and_block_deltas(spark):
    xs = [0.5 * k for k in range(1, 400)] + [1e3, 1e6 + 0.5, 1e9]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", B.lgamma("x").alias("y")).collect():
        assert math.isclose(r.y, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-11)
    r = one(spark, B.kt(F.lit(0), F.lit(0), F.lit(2)).alias("a"), B.mixture_bits(F.lit(3.0), F.lit(3.0)).alias("b"), B.equal_cost(F.lit(1.0), F.lit(1.0 + 2**-50)).alias("c"), B.elias_delta(F.lit(1)).alias("d"))
    assert (r.a, round(r.b, 9), r.c, r.d) == (1.0, 3.0, True, 1.0)


def test_parsers(spark):
    specs = "{Color=[red, blue], Size=[M], Bad, Empty=[], Color=[green]}"
    box = "x {{Infobox film|name=[[A|B]] c|year={{small|1999}} 2000|text='''bold''' <i>z</i>|k|director=[[D]]}} tail|no=1"
    r = one(spark, T.parse_specs(F.lit(specs)).alias("s"), T.infobox(F.lit(box)).alias("b"), T.json_objects(F.lit('```json\n[{"a": 1}, {"b": 2}]\n```')).alias("j"), T.json_objects(F.lit('[{"a": 1}, {"b": ')).alias("h"))
    assert r.s == {"Color": "green", "Size": "M"}
    assert r.b == {"name": "B c", "year": "2000", "text": "bold z", "director": "D"}
    assert [x.replace(" ", "") for x in r.j] == ['{"a":1}', '{"b":2}'] and [x.replace(" ", "") for x in r.h] == ['{"a":1}']
    for s, want in (("3:05", 185.0), ("4m 10sec", 250.0), ("215000", 215.0), ("3.5", 210.0), ("0", None), ("soon", None)):
        assert one(spark, T.parse_duration(F.lit(s)).alias("d")).d == want
    rec = F.create_map(F.lit("b"), F.lit("two"), F.lit("a"), F.lit("one"))
    r = one(spark, T.record_text(rec).alias("t"), T.value_spans(rec).alias("v"), T.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("q"))
    assert r.t == "a: one; b: two" and [r.t[v.start : v.end] for v in r.v] == ["one", "two"] and r.q == 0.75


def test_generators_do_not_depend_on_partitioning(spark):
    for make in (lambda: G.planted(spark, 200), lambda: G.cover(spark, 100), lambda: G.tree(spark, 3, 100), lambda: G.relations(spark, 200), lambda: G.zipf_null(spark, 100), lambda: G.multi_membership(spark, 100)):
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(make()) == rows(make().repartition(7))
    base = G.planted(spark, 300)
    shuffled = G.shuffled_values(base.select("rec_id", "rec"))
    assert R.cells(shuffled).groupBy("key", "value").count().subtract(R.cells(base).groupBy("key", "value").count()).count() == 0
    assert G.independent_null(base.select("rec_id", "rec")).count() > 0


def test_relation_mining_finds_the_planted_schema(spark):
    cells = R.cells(G.relations(spark, 3000)).cache()
    gold = {(r.kind, r.a, r.b) for r in G.relations_gold(spark).collect()}
    implied = mining.implications(cells)
    spec = {("specialises", r.child, r.parent) for r in implied.collect()}
    assert spec >= {g for g in gold if g[0] == "specialises"}
    sib = {("sibling", r.key_a, r.key_b) for r in mining.siblings(cells, implied).collect()}
    assert sib >= {g for g in gold if g[0] == "sibling"}
    syn = {("synonym", r.key_a, r.key_b) for r in mining.synonyms(cells).collect()}
    assert syn == {g for g in gold if g[0] == "synonym"}
    fd = {("value_edge", r.a, r.b) for r in mining.dependencies(cells).collect()}
    assert ("value_edge", "city", "country") in fd and ("value_edge", "country", "city") not in fd


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[float(rng.randint(0, 9)) for _ in range(m)] for _ in range(n)]
        rows = metrics.assignment(w)
        used = [r for r in rows if r >= 0]
        assert len(used) == len(set(used))
        best = max(sum(w[i][j] for i, j in zip(p, q)) for k in [min(n, m)] for p in permutations(range(n), k) for q in [tuple(range(k))] for q in permutations(range(m), k)) if n * m <= 12 else None
        if best is not None:
            assert sum(w[i][j] for j, i in enumerate(rows) if i >= 0) == best


def test_sequential_baselines():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])[rng.permutation(120)]
    for labels in (baselines.dp_means(x, 2.0), baselines.leader(x, 1.5), baselines.leader(x, 1.5, first=True), baselines.summaries(x, 1.0), baselines.sequential_kmeans(x, 3, spread_out=True)):
        groups = {}
        for p, k in zip(x, labels):
            groups.setdefault(k, []).append(p)
        assert len(groups) == 3 and all(np.std(g, axis=0).max() < 0.5 for g in groups.values())
    z, a = baselines.bp_means(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]] * 20), 0.3)
    assert np.abs(z @ a - np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]] * 20)).max() < 0.05
    assert baselines.heuristic_lam(x, 3) < 2


def test_components_and_covers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (20, 21), (21, 22), (22, 23), (23, 24)], "a long, b long")
    got = {r.node: r.root for r in baselines.connected_labels(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    w = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.6), (1, "c", 0.1), (2, "a", 0.0), (2, "b", 0.0)], "rec_id long, group string, w double")
    assert sorted((r.rec_id, r.group) for r in baselines.soft_cover(w).collect()) == [(1, "a"), (1, "b"), (2, "a")]
