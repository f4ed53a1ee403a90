import math

import numpy as np
import pyarrow as pa
import pytest

from bitquarry.llm import language
from bitquarry.llm.language import Model, fit, grams, identified, letters_of, mix, predict

WORDS = {"en": "the of and that with thing which house water", "de": "der die und nicht für ein groß wasser straße", "fr": "le la et que qui été maison où français"}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split(), n)) + "."


def bucket(s, buckets):
    h = np.array([len(s)], np.uint64)
    with np.errstate(over="ignore"):
        for c in s:
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(ord(c))
        return int(mix(h)[0] & np.uint64(buckets - 1))


def plain(s):
    """Letters in lower case, one space for each run of others."""
    out = ""
    for c in s.lower():
        if c.isalpha():
            out += c
        elif not out.endswith(" "):
            out += " "
    return out


def test_letters_and_grams_of_a_batch_equal_those_of_single_texts():
    texts = ["Ab, cÉ 12!", "", "...", "x", None, "  çA  b", "漢字😀é", "a" * 700]
    points, offsets = letters_of(pa.array(texts))
    for i, t in enumerate(texts):
        own = plain(t or "")
        assert "".join(map(chr, points[offsets[i] : offsets[i + 1]])) == own
        for order in language.ORDERS:
            got = [b for b in grams(points, offsets, order, 1024)[offsets[i] : offsets[i + 1]].tolist() if b < 1024]
            assert got == [bucket(own[k : k + order], 1024) for k in range(len(own) - order + 1)]


def test_predictions_equal_plain_naive_bayes(monkeypatch):
    monkeypatch.setattr(language, "_AT_ONCE", 4096)  # texts are cut by it
    rng = np.random.default_rng(1)
    matrix = np.concatenate([rng.integers(-40000, -8000, (256, 3)), np.zeros((1, 3), int)]).astype(np.int32)
    m = Model(["a", "b", "c"], matrix, np.log(np.array([0.5, 0.3, 0.2])))
    texts = ["hello", "Straße 7", "", "12 34", "x" * 9000, "de la mer " * 2000, None, "été"]
    langs, scores = predict(pa.array(texts), m)
    for t, lang, score in zip(texts, langs, scores):
        s = plain(t or "")
        if not s.strip():
            assert (lang, score) == ("und", 0.0)
            continue
        z = [sum(int(matrix[bucket(s[k : k + o], 256), j]) for o in language.ORDERS for k in range(len(s) - o + 1)) / (4096 * 4) + m.prior[j] for j in range(3)]
        assert lang == "abc"[z.index(max(z))]
        assert math.isclose(score, 1 / sum(math.exp(x - max(z)) for x in z), rel_tol=1e-12)


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    return [(i, text(rng, lang, int(rng.integers(3, 40))), lang) for i, lang in enumerate(rng.choice(list(WORDS), 400))]


def test_query_learns_outside_the_held_out_rows_and_is_right_there(spark, tmp_path, rows):
    import zlib

    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]  # a label of held-out rows alone
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ... 3", "de"), (1003, "the house " * 30_000, None), (None, "the and", "en"), *wrong[:3]]
    spark.createDataFrame([(*r, "s") for r in wrong + odd], "doc_id long, text string, lang string, __bq_lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op12_language(spark, str(tmp_path)).collect()
    assert len(got) == len(wrong) + len(odd)
    truth = {i: lang for i, _, lang in rows} | {1000: "und", 1001: "und", 1002: "und", 1003: "en", None: "en"}
    for r in got:
        assert r.lang_pred == truth[r.doc_id], r
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0)


def test_model_does_not_depend_on_partitions_and_bounds_its_size(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = fit(df.coalesce(1)), fit(df.repartition(7))
    assert a.langs == b.langs == sorted(WORDS) and (a.matrix == b.matrix).all()
    few = fit(df, sample=40)
    assert few.langs == a.langs and (few.matrix != a.matrix).any()
    monkeypatch.setattr(language, "CELLS", 3 << 10)
    assert fit(df).buckets == 1 << 10


def test_nothing_to_learn_or_to_answer(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, "abc", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert fit(df) is None
    assert {(r["__bq_lang"], r["__bq_score"]) for r in identified(df, None).collect()} == {("und", 0.0)}
    assert fit(df.limit(0)) is None and identified(df.limit(0), None).count() == 0
