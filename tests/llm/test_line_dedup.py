import random

from bitquarry.llm.line_dedup import dedup, fingerprints


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."


def test_passages_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    own = lambda: " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(8))
    passage = " ".join(sentence(rng, rng.randint(6, 14)) for _ in range(6))
    line = sentence(rng, 60)
    short = sentence(rng, 9)
    rows = [
        (1, own() + " " + passage + "\n" + own()),
        (2, own() + "\n" + passage + " " + own()),
        (3, passage),
        (4, own() + "\n" + line + "\n" + own()),
        (5, line + "\n" + own()),
        (6, short + "\n" + own()), (7, short + "\n" + own()),
        (8, None), (9, ""), (10, "x" * 30_000 + " y. " + own()),
        (11, "\n".join([sentence(rng, 3)] * 40)),
    ]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in dedup(docs).collect()}
    before = dict(rows)
    assert set(got) == set(before) and all(r.fp == "a" for r in got.values())
    for i in (1, 4, 6, 7, 8, 9, 10):
        assert got[i].text == before[i]
    assert passage not in got[2].text and got[3].text == ""
    assert len(got[2].text.split()) < len(before[2].split()) - 35
    assert line not in got[5].text and got[5].text == before[5].split("\n")[1]
    assert len(got[11].text.split()) < 60 < len(before[11].split())


def test_equal_rows_share_a_decision_and_empty_tables(spark):
    rng = random.Random(2)
    text = " ".join(sentence(rng, 10) for _ in range(10))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "other"), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.text) for r in dedup(docs).collect()))
    assert got == sorted([(1, text), (1, text), (2, ""), (2, "other"), (-1, text)])
    assert dedup(docs.limit(0)).count() == 0


def test_runs_match_brute_force(spark):
    """Every unit in a run of 55 words or more that stands earlier too is deleted, and nothing that is new."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        us = [sentence(rng, rng.randint(5, 15)) for _ in range(20)]
        if i >= 20:
            src = rows[rng.randrange(20)][1]
            k = rng.randrange(10)
            at = rng.randrange(15)
            us[at:at] = src[k : k + rng.randint(6, 9)]
        rows.append((i, us))
    docs = spark.createDataFrame([(i, " ".join(us)) for i, us in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split(". ") for r in dedup(docs).collect()}
    seen = []
    for i, us in rows:
        must, may = set(), set()
        for a in range(len(us)):
            for b in range(a + 1, len(us) + 1):
                n = sum(len(u.split()) for u in us[a:b])
                if any(us[a:b] == old[k : k + b - a] for old in seen for k in range(len(old) - (b - a) + 1)):
                    may.update(range(a, b)) if n >= 25 else None
                    must.update(range(a, b)) if n >= 55 else None
        left = [u.strip().rstrip(".") for u in got[i]]
        for k, u in enumerate(us):
            if k in must:
                assert u.rstrip(".") not in left
            if k not in may:
                assert u.rstrip(".") in left
        seen.append(us)


def test_passages_that_begin_and_end_inside_sentences_go(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    one, spam = words(50), words(50)
    mid = words(20) + ". " + words(10) + ". " + words(20)
    rows = [
        (1, f"{words(9)} {one} {words(9)}."), (2, f"{words(8)} {one} {words(7)}."),
        (3, f"{words(6)} {mid} {words(6)}."), (4, f"{words(5)} {mid} {words(4)}."),
        (5, "buy " * 3000 + spam), (6, words(30) + "\n" + spam + " buy" * 2000),
    ]
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = dict(rows)
    assert got[1] == before[1] and got[3] == before[3]
    assert got[2] == before[2].replace(one + " ", "") and got[4] == before[4].replace(mid + " ", "")
    assert got[5].count("buy") <= 25 and got[5].endswith(spam)
    assert spam not in got[6] and got[6].count("buy") <= 25


def test_no_python_runs_on_executors(spark):
    docs = spark.createDataFrame([(1, "a " * 60), (2, "b " * 60 + "a " * 60), (3, "c")], "doc_id long, text string")
    out = dedup(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan
    assert {r.doc_id: len(r.text.split()) for r in out.collect()} == {1: 1, 2: 1, 3: 1}
    found = fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in found and "Python" not in found


def test_copied_words_go_exactly_whatever_the_white_space(spark):
    """Passages of 25 words or more, dealt with other white space, are cut at their words; the rest keeps every byte."""
    rng = random.Random(5)
    gap = lambda: rng.choice([" ", " ", " ", "\n", "\t", " \r\n ", "\x0b", "\x0c"])
    word = lambda: rng.choice(["é", "字 ", "W ", ""]) + f"w{rng.randrange(10**6)}"
    source = [[word() for _ in range(rng.randint(60, 200))] for _ in range(12)]
    rows = [(i, gap() + gap().join(ws) + gap() + gap()) for i, ws in enumerate(source)]
    want = dict(rows)
    for i in range(12, 50):
        left, text = [], ""
        for _ in range(rng.randint(1, 3)):
            own = "".join(word() + gap() for _ in range(rng.randint(1, 30)))
            src = source[rng.randrange(12)]
            n = rng.choice([12, 25, 26, 40, 60])
            k = rng.randrange(len(src) - n + 1)
            copied = "".join(w + gap() for w in src[k : k + n])
            left.append(own + (copied if n == 12 else ""))
            text += own + copied
        start = rng.choice(["", "\n ", " "])
        rows.append((i, start + text))
        want[i] = start + "".join(left)
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_ids_beyond_forty_bits(spark):
    text = sentence(random.Random(6), 80)
    ids = [-(1 << 62), -5, 1 << 45, (1 << 62) + 1]
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect()}
    assert got == {i: text if i == ids[0] else "" for i in ids}
