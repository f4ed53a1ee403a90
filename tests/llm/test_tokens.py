import random
import zlib

import numpy as np
import pytest

from bitquarry.llm._tokenize import ChunkEncoder
from bitquarry.llm.packing import pack, plan
from bitquarry.llm.token_files import load, pack as code, unpack, write

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tnew\n\nline\r\n", "Ümlaut naïve ΣΑΣ İ 漢字かな 🙂🙂", "it's we'll 123 4567 x" * 3, "<|endoftext|> in text", "\u00a0nbsp\u3000ideographic", "e\u0301 x \u0301y", "a\x1cb \x01c", "x \x02", "\x85 b", "a\u2003b", " lead", "trail\n", "The and attion to thanedble the, anea. Eriner thanea.\nThen edinth.", "x" * 5000, "word " * 3000]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_whole_texts(name, keeps):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    enc = ChunkEncoder(public_tokenizers.path(name), keeps, cache_bytes=5_000)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", " ", "\n", "é", "1", "'", "s", ".", "\t", "Z", "\u0301", "漢"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_the_cache_stays_in_its_bytes():
    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), True, cache_bytes=100_000)
    for k in range(40):
        enc.encode([" ".join(f"w{k}x{j}" for j in range(100))])
        assert enc.held <= 100_000 + 100 * 400 and len(enc.cache) + len(enc.old) < 2 * 140_000 / 250


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000, 4097):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = code(v)
        assert len(control) == -(-n // 4) and (unpack(control, data, n) == v).all()
    assert len(code(np.zeros(8, np.uint32))[1]) == 8


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 31, TEXTS[i % len(TEXTS)], "x") for i in range(31)] + [(3, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t")
    got = sorted(load(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text, _ in rows:
        want.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted(d for d, _, _ in rows)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def optimum(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b + lengths[i] <= capacity}.values():
            bins[k] += lengths[i]
            go(i + 1, bins)
            bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_plan_is_near_the_optimum_and_places_everything():
    rng = random.Random(4)
    over = 0
    for _ in range(150):
        cap = rng.choice([10, 20, 50])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        hist = {x: lengths.count(x) for x in lengths}
        runs = plan(hist, cap)
        placed = sorted(x for ls, n in runs for x in ls * n)
        assert placed == sorted(lengths) and all(sum(ls) <= cap for ls, _ in runs)
        over += sum(n for _, n in runs) - optimum(lengths, cap)
    assert over <= 3
    big = {x: rng.randint(0, 50_000) for x in range(1, 4097)}
    runs = plan({k: v for k, v in big.items() if v})
    bound = -(-sum(k * v for k, v in big.items()) // 4096)
    assert sum(n for _, n in runs) <= bound * 1.001 + 1


def test_pack_rows(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(99, "word " * 9000), (99, "twice"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    seqs = {}
    for r in got:
        assert 0 < r.length <= 4096 and r.start == r.piece * 4096
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(seqs) == -(-total // 4096)
    assert sum(r.piece == 0 for r in got) == len(rows)
    assert pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_no_worker_keeps_an_encoder_after_packing(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r.doc_id for r in got) == list(range(64)) and {r.sequence_id for r in got} == {0}

    def held(batches):
        from bitquarry.llm import _tokenize

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_tokenize._ENCODERS)], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 32).mapInArrow(held, "n long").collect()} == {0}
