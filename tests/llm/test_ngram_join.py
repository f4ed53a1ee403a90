import glob
import os
import random
import time

import numpy as np

from bitquarry.llm._components import components, contract
from bitquarry.llm.ngram_join import _received, _sent, keep_one, link_sets, shingle_sets, similar_groups


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(50))
            if rng.random() < 0.3:
                w = w + ["tail"]
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 30, 60, 120]))]
        rows.append((i, " ".join(w)))
    return rows


def test_join_is_exact(spark):
    for seed in (1, 2):
        rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = brute(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df).collect()} == want
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, tile_shingles=60).collect()} == want


def test_repeated_ids_nulls_extra_columns_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t, "b"), (None, t, "c"), (3, "other", "d")], "doc_id long, text string, node string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in similar_groups(df).collect()))
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.node for r in kept.collect()) == ["a", "a", "c", "d"]
    assert similar_groups(df.limit(0)).count() == 0


def test_link_sets_and_components_match_brute_force(spark):
    rows = corpus(3, 200)
    sets = list(shingle_sets([t for _, t in rows]))
    edges = link_sets([i for i, _ in rows], sets)
    a, r = contract(np.array([x for x, _ in edges]), np.array([y for _, y in edges]))
    root = dict(zip(a.tolist(), r.tolist()))
    assert {i: root.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows).items()}
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 660)]
    a, r = contract(np.array([x for x, _ in edges]), np.array([y for _, y in edges]))
    want = dict(zip(a.tolist(), r.tolist()))
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def test_very_long_text():
    sets = list(shingle_sets([" ".join(f"w{i % 70000}" for i in range(900_000)), "a b c d", "x" * 100_000 + " y z q"]))
    assert [len(s) for s in sets] == [70000, 1, 1]


def test_pipeline_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    text = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join(text + [f"n{k}" for k in range(20)])), (3, " ".join(text + [f"m{k}" for k in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_join(spark, docs, "").collect()) == [1, 3]
    assert keep_one(docs).count() == 3


def test_sent_signatures_stay_short_in_small_buckets():
    rng = np.random.default_rng(5)
    for low, high, n, most in ((0, 1000, 700, 8), (-(2**62), -(2**62) + 3_000_000, 700, 10), (0, 3_000_000, 9000, 10), (-(2**63), 2**63 - 1, 50, 15), (7, 8, 1, 9)):
        some = rng.integers(low, high, max(1, n * 5 // 7), dtype=np.int64)
        sig, doc = rng.integers(0, 2**64 - 1, n, dtype=np.uint64), rng.choice(some, n)
        packed = _sent(sig, doc)
        assert sum(map(len, packed)) <= most * n + 9
        back = _received(*map(memoryview, packed))
        assert (back[0] == sig & np.uint64(2**48 - 1)).all() and (back[1] == doc).all()


def test_written_steps_leave_no_shuffle_files(spark):
    from bitquarry.llm._common import materialize

    where = [os.environ.get("SPARK_LOCAL_DIRS"), spark.conf.get("spark.local.dir", None), "/tmp"]
    files = lambda: {f for d in filter(None, where) for f in glob.glob(f"{d}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}
    before = files()
    df = spark.range(200_000).groupBy("id").count()
    assert materialize(df).count() == 200_000
    for _ in range(50):  # removed by the executors, shortly after
        left = [f for f in files() - before if os.path.exists(f) and os.path.getsize(f) > 100_000]
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_documents_that_surely_stay_are_not_dealt(spark, tmp_path):
    from bitquarry.llm.ngram_join import _perhaps

    spark.createDataFrame([(i if i % 50 else None, f"text {i}") for i in range(1, 2001)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    ids = docs.filter("doc_id % 7 = 0").select("doc_id")
    some, rest = _perhaps(docs, ids), _perhaps(docs, ids, "left_anti")
    got, other = [r.doc_id for r in some.collect()], [r.doc_id for r in rest.collect()]
    want = {r.doc_id for r in ids.collect()}
    assert want <= set(got) and len(got) < 1.1 * len(want) + 5 and not want & set(other)
    assert len(got) + len(other) == 2000 and sum(x is None for x in other) == 40
    # texts stay where they are: nothing but ids goes through an exchange
    for df in (some, rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not any("Exchange hashpartitioning(doc_id" in line for line in plan.splitlines())


def test_sets_without_enough_shared_shingles_leave_a_large_component(spark, monkeypatch):
    """Shared shingles by plain counts; chained texts that are mostly their own never reach the tiles."""
    import random
    from collections import Counter

    from bitquarry.llm import ngram_join

    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = words(40)
    rows = [(i, " ".join([*words(60), *common])) for i in range(30)]
    rows += [(100 + i, rows[0][1] + " end" * (i > 0)) for i in range(3)] + [(200, None), (201, ""), (202, "two words"), (203, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} if len(t := (x or "").split()) >= 5 else ({tuple(t)} if t else set()) for i, x in rows}
    stands = Counter(s for x in sets.values() for s in x)
    want = {i: n for i, x in sets.items() if (n := sum(stands[s] > 1 for s in x))}
    assert {r.doc_id: r.shared for r in ngram_join.shared_shingles(docs, 7, 5).collect()} == want

    tiled = []
    step = ngram_join._sized
    monkeypatch.setattr(ngram_join, "_sized", lambda *a: tiled.append(step(*a)) or tiled[-1])
    edges = spark.createDataFrame([(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j]], "doc_id long, other long")
    monkeypatch.setattr(ngram_join, "components", lambda e, real=ngram_join.components, used=[]: real(edges if not used and not used.append(1) else e))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, tile_shingles=400, width=5, num=80, den=100).collect()}
    assert got == {i: {100: 0, 101: 0, 102: 0, 203: 202}.get(i, i) for i in sets}
    assert {r.doc_id for r in tiled[1].collect()} <= {0, 100, 101, 102, 202, 203}


def test_counts_of_shared_shingles_are_packed_by_bucket(spark):
    """A bucket has a row for each part of the ids, not one for each document with a shared shingle there."""
    from bitquarry.llm import ngram_join

    common = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(i - 200, f"{common} own{i}") for i in range(400)] + [(-200, f"{common} own0"), (500, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ngram_join.shared_shingles(docs, 5, 5)
        got = {r.doc_id: r.shared for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # 56 shingles of all; the one with the last word stands twice in the doubled row alone
    assert got == {i - 200: 56 if i else 2 * 57 for i in range(400)}

    def made(node):
        below = [n for k in range(node.children().size()) for n in made(node.children().apply(k))]
        return below + ([node.metrics().apply("pythonNumRowsReceived").value()] if "FlatMapGroupsInArrow" in node.nodeName() else [])

    assert made(df._jdf.queryExecution().executedPlan())[0] <= 5 * 5


def test_workers_keep_small_tables_for_word_hashes():
    from bitquarry.llm import _common

    raw = np.frombuffer(b"one " + b"x" * 200_000 + b" " + b"three " * 50_000, np.uint8)
    places = lambda r: (s := np.flatnonzero((r != 32) & np.concatenate([[True], r[:-1] == 32])), np.flatnonzero((r == 32) & np.concatenate([[False], r[:-1] != 32])))
    starts, ends = places(raw)
    h = _common.word_hashes(raw, starts, ends)
    # the same hash wherever a word stands
    alone = _common.word_hashes(raw[4:], *places(raw[4:]))
    assert (h[1:] == alone).all() and len(set(h.tolist())) == 3
    assert sum(x.nbytes for x in _common._powers(_common._HASHED)) < 4 << 20


def test_large_arrays_go_back_as_they_are_freed():
    """Freed arrays of 20 MB are given back even below one that stays, without a call that trims."""
    import re
    import subprocess
    import sys

    code = """
import re
import numpy as np
import pyarrow as pa
from bitquarry.llm._common import lean_group
anon = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
np.ones(3 << 20).sum()  # the C library raises its limit as this goes
run = lean_group(lambda table: [np.ones(5 << 19) for _ in range(5)] + [bytearray(200_000)])
table = pa.table({"a": [1]})
before = anon()
kept = run(table)[-1]
print(anon() - before)
"""
    if not sys.platform.startswith("linux"):
        return
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 20, out.stdout
