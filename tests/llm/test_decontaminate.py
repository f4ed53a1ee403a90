import random

from bitquarry.llm._common import alnum_words
from bitquarry.llm.decontaminate import SuffixAutomaton, contamination, cut, items_digest, remove


def brute(words, items, w):
    hit, found = set(), set()
    for name, ws in items:
        if not ws:
            continue
        k = w if len(ws) >= w else len(ws)
        wins = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(name)
    return hit, found


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        w = rng.choice([3, 4, 5])
        letters = [b"a", b"b", b"c"][: rng.choice([2, 3])]
        items = [(str(k), [rng.choice(letters) for _ in range(rng.randint(0, 12))]) for k in range(rng.randint(0, 6))]
        auto = SuffixAutomaton(items, w)
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 60))]
        spans, found = auto.scan(words)
        hit = {i for a, b in spans for i in range(a, b)}
        assert (hit, found) == brute(words, items, w)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_contamination_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "Intro " + item.upper() + " end", "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x"), (5, " ".join("q" * 400) + " " + " ".join(item.split()[:13]), "x"), (1, "none", "x")]
    bench = [(7, item), (8, None), (9, "?!"), (10, "tiny item"), (7, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string, __n string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b).collect())
    none = items_digest([])
    assert got == sorted([
        (1, 22, 20, 1, items_digest(["7"]), True), (1, 1, 0, 0, none, False), (2, 0, 0, 0, none, False), (3, 0, 0, 0, none, False),
        (4, 2, 2, 1, items_digest(["10"]), True), (5, 413, 13, 1, items_digest(["7"]), False)])
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0


def test_blocks_and_remove(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, "a, " + item + "; b"), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "x y z " * 6)], "item_id long, text string")
    from bitquarry.llm.decontaminate import scan

    one = {r.doc_id: (r.__getitem__("__bq_spans"), r.__getitem__("__bq_items")) for r in scan(docs, bench).collect()}
    many = {r.doc_id: (r.__getitem__("__bq_spans"), r.__getitem__("__bq_items")) for r in scan(docs, bench, block_words=1).collect()}
    assert one == many
    assert sorted(r.doc_id for r in remove(docs, bench).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in remove(docs, bench, "cut").collect()} == {1: "a, ; b", 2: "clean text", 3: None}


def test_cut_counts_words_as_the_rule_does():
    text = "Ab, cd-éf g1"
    assert alnum_words(text) == [b"ab", b"cd", "éf".encode(), b"g1"]
    assert cut(text, [[1, 3]]) == "Ab,  g1"
