import hashlib
import random
import re

import pyarrow as pa

from bitquarry.llm.fill_middle import op13_fill_middle, rearrange, rearranged


def brute(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", text, None, None
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), *(("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")), len(p), len(m))


def odd_texts(n=1500):
    rng = random.Random(5)
    bits = ["a", "é", "漢", "😀", "\n", "\n\n", "<", "P", "S", "M", ">", "<P", "<<S", "\r\n", " "]
    out = ["".join(rng.choice(bits) if rng.random() > 0.003 else rng.choice(["<P>", "<S>", "<M>"]) for _ in range(rng.choice([0, 1, 2, 5, 60, 253, 256, 300, 900]))) for _ in range(n)]
    return out + ["\n", "x", "x\n", "é" * 128, "é" * 128 + "\n", "a" * 255 + "<", "a" * 254 + "<P>", "a" * 255 + "<P>b\n", "<P<P>", "<\nP>", "ab\n" * 40_000 + "end", "漢" * 100_000, ("z" * 255 + "\n") * 9]


def test_outputs_equal_the_definition():
    texts = [*odd_texts(), None]
    for args in ({}, {"rate": 50, "spm": 10, "seed": 3}):
        out = rearrange(list(range(len(texts))), pa.array(texts), **args)
        for i, t in enumerate(texts):
            got = (out["n"][i], out["form"][i], out["output"][i].decode(), out["prefix_chars"][i], out["middle_chars"][i])
            assert got == brute(i, t, **args), (i, t)
            if out["cuts"][i]:
                x, y = out["cuts"][i]
                raw = t.encode()
                assert (len(raw[:x].decode()), len(raw[x:y].decode())) == got[3:]
        assert set(out["form"]) == {"plain", "psm", "spm"}


def test_query_digests_and_exact_round_trip(spark, tmp_path):
    texts = odd_texts(300)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a\nb\n", "x"), (5000, None, None), (3, texts[3], "y")]
    spark.createDataFrame(rows, "doc_id long, text string, __bq_form string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_fill_middle(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {i: t for i, t, _ in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, form, output, p, m = brute(r.doc_id, by[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(by[r.doc_id] or ""))


def test_other_columns_stay_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, "a\nb", 2.5, "p")], "doc_id long, text string, n double, form string")
    r = rearranged(df).collect()[0]
    assert (r.n, r.form, r["__bq_n"]) == (2.5, "p", 2)
    assert rearranged(df.limit(0)).count() == 0
