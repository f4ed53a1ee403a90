import random
import re

from bitquarry.llm.licenses import scan
from bitquarry.llm.toxicity import Model, reject, scored, segments, train


def brute_segments(hits, cost, n):
    """Ruzzo and Tompa's definition: the best segment, then the same on both sides of it."""
    score = [-cost] * n
    for i, s in hits:
        score[i] = s

    def go(a, b):
        best = max(((sum(score[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return go(a, i) + [(round(best[0], 6), i, j)] + go(j, b)

    return go(0, n)


def test_segments_match_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 25)
        hits = sorted((i, rng.choice([1.37, 2.11, 0.53, 3.19])) for i in rng.sample(range(n), rng.randint(0, min(n, 8))))
        got = [(round(s, 6), a, b) for s, a, b in segments(hits, 0.71)]
        assert got == brute_segments(hits, 0.71, n)


def test_segments_are_linear():
    import time

    for hits in ([(3 * i, 1.0) for i in range(100_000)], [(i, 1.0) for i in range(100_000)], [(2 * i, 1.0 + 0.5 * (i % 3)) for i in range(100_000)]):
        began = time.process_time()
        segments(hits, 1.5)
        assert time.process_time() - began < 5


def test_learns_and_scores(spark):
    rng = random.Random(2)
    bad = ["vile", "rot", "scorn"]
    docs, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, y))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "vile rot scorn " * 20_000, "x"), (0, docs[0][1], "x")]
    labels += [(5, None), (None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    m = train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(m.lexicon) >= {b"vile", b"rot", b"scorn"}
    got = {r.doc_id: r["__bq_score"] for r in scored(d, m).collect()}
    truth = dict(labels)
    wrong = sum((got[i] >= 0.5) != bool(truth[i]) for i in range(600))
    assert wrong <= 6 and got[1000] < 0.5 and got[1001] < 0.5 and got[1002] >= 0.5
    kept = {r.doc_id for r in reject(d, m).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert reject(d, m).columns == d.columns
    none = train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none == Model() and {r["__bq_score"] for r in scored(d, none).collect()} == {0.0}


def test_license_base_counts_match_brute_force_and_labels(spark):
    rng = random.Random(3)
    word = ["mit", "license", "MIT", "License", "apache", "general", "public", "gnu", "x", "é", "1"]
    texts = ["".join(rng.choice(word) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += [None, "", "...", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "all rights not reserved", "All rights reserved", "lic-ense mit\u0130 license", "mit license " * 2000]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ws string")
    got = {r.doc_id: r for r in scan(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        starts, labels = [], set()
        for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            ps = p.split()
            s = [k for k in range(len(w)) if w[k : k + len(ps)] == ps]
            starts += s
            labels |= {label} if s else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) | set() if labels else True
        assert 0 <= r.score <= 1
    by = {t: got[i].labels for i, t in enumerate(texts) if t}
    assert by["Licensed under CC BY-NC 4.0."] == "cc-by-nc-4.0" and by["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert by["all rights not reserved"] == "" and by["All rights reserved"] == "all-rights-reserved"
    assert scan(df.limit(0)).count() == 0


def test_license_labels_of_files_with_several_licenses(spark):
    from bitquarry.llm.licenses import TEMPLATES

    several = "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0. All rights reserved. This work is licensed under the GNU General Public License, version 3."
    notice = ". ".join(t for t, _, _ in TEMPLATES)
    elsewhere = "Mozilla Public License. Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, several), (2, notice), (3, elsewhere)] + [(k, "gnu general public license version 3") for k in range(4, 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    assert got[1].labels == "all-rights-reserved,apache,apache-2.0,cc-by-nc-4.0,gpl,gpl-3.0"
    assert got[2].labels == ",".join(sorted({x for _, x, _ in TEMPLATES} | {"apache", "gpl", "mit"})) and got[2].score == 1.0
    assert got[3].labels == "apache,apache-2.0,mpl-2.0"


def test_license_labels_and_scores_match_brute_force(spark):
    from bitquarry.llm.licenses import BASE, TEMPLATES

    rng = random.Random(5)
    parts = [" ".join(t.split()[a:b]) for t, _, ks in TEMPLATES for a, b in ((0, None), (1, None), (0, -1))] + [k for _, _, ks in TEMPLATES for k in ks] + ["license", "public", "x y", "4 0", "Version 2"]
    texts = [". ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]+", t.lower())
        at = lambda ps: [k for k in range(len(w)) if w[k : k + len(ps)] == ps]
        labels = {label for p, label in BASE if at(p.split())}
        score = 0.5 if labels else 0.0
        for text, label, (key,) in TEMPLATES:
            ts, ks = text.split(), key.split()
            off = next(k for k in range(len(ts)) if ts[k : k + len(ks)] == ks)
            for p in at(ks):
                labels.add(label)
                score = max(score, sum(0 <= p - off + k < len(w) and w[p - off + k] == x for k, x in enumerate(ts)) / len(ts))
        assert got[i].labels == ",".join(sorted(labels)), t
        assert abs(got[i].score - score) < 1e-9, t
