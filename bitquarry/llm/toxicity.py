"""Toxicity by maximum-scoring segments over token log-odds.

Training. Words of labelled documents are counted by class (documents that
hold the word; equal texts count once). A word's score is its log-odds between
the classes under an informative Dirichlet prior, whose mean is the word's
share of both classes and whose weight is ``PRIOR`` times the toxic texts, so
rare words shrink to none; only words whose score is
``z_least`` standard errors above none enter the lexicon. Every other word
costs a constant, fitted so that the expected score of a word of a clean
document is negative, as segment statistics need.

Scoring. A linear scan finds every maximal scoring segment of a text. A
segment's score has an extreme-value distribution over clean text of that
length, with parameters solved from the score distribution (lambda) and fitted
on the clean training documents (K); that gives each segment an expectation by
chance. Segments below ``e_most`` are toxic passages. A logistic function of
the best segment's bits and the passages' number, fitted on the training rows,
makes the document's score.

Learning takes at most ``sample`` distinct labelled texts, those with the
smallest hash of doc_id (documented bound), and equal texts teach once; scoring
covers every text whole.

Defined results: null and empty texts have the score of no segment; repeated
rows give equal rows; a label that is null teaches nothing; without labels of
both classes every score is 0; an empty table gives an empty result; other
columns are kept by ``reject`` and never read otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import alnum_words, arrow_batches, lean, materialize, read

SAMPLE = 20_000
PRIOR = 10
Z_LEAST = 2.5
E_MOST = 0.01


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    cost: float = 1.0
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    trained: bool = False

    def surprise(self, scores: list[float], n: int) -> tuple[float, int]:
        """Bits of the best segment's surprise in a text of n words, and how many segments are significant."""
        chance = [self.k * n * math.exp(-min(700.0, self.lam * s)) for s in scores]
        return max(0.0, -math.log2(max(min(chance), 1e-300))) if chance else 0.0, sum(e <= E_MOST for e in chance)


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, from, to) where words outside hits cost ``cost`` each; linear in hits.

    Ruzzo and Tompa's method: each candidate knows the running sum left of it
    and at its right end, and the nearest earlier candidate with a smaller left
    sum; a new one joins that candidate, unless its right sum is as great. When
    there is none, no later candidate can join any so far.
    """
    done: list[list] = []
    found: list[list] = []  # left sum, right sum, from, to, nearest earlier one with a smaller left sum
    total, at = 0.0, 0
    for i, s in hits:
        total -= cost * (i - at)
        at = i + 1
        cand = [total, total + s, i, i + 1, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= cand[0]:
                j = found[j][4]
            if j < 0:
                done += found
                found = [cand]
                break
            if found[j][1] >= cand[1]:
                cand[4] = j
                found.append(cand)
                break
            cand = [found[j][0], cand[1], found[j][2], cand[3], -1]
            del found[j:]
    return [(r - l, a, b) for l, r, a, b, _ in done + found]


def _solve_lambda(shares: list[tuple[float, float]], cost: float) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1; what shares leave costs ``cost``."""
    rest = 1 - sum(p for p, _ in shares)

    def f(x: float) -> float:
        return rest * math.exp(-cost * x) + sum(p * math.exp(min(700, s * x)) for p, s in shares) - 1

    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def features(words: list[bytes], m: Model) -> tuple[float, int, list[tuple[float, int, int]]]:
    """Bits of the best segment's surprise, number of significant segments, and these."""
    get = m.lexicon.get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    if not hits:
        return 0.0, 0, []
    found = segments(hits, m.cost)
    bits, _ = m.surprise([s for s, _, _ in found], len(words))
    good = [x for x in found if m.surprise([x[0]], len(words))[1]]
    return bits, len(good), good


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _row(bits: float, n: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(bits), math.log1p(n)


def score(words: list[bytes], m: Model) -> tuple[float, list[tuple[float, int, int]]]:
    """The document's score and its toxic passages."""
    if not m.trained:
        return 0.0, []
    bits, n, good = features(words, m)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(m.weights, _row(bits, n))))))), good


def _counted(rows: DataFrame, lexicon: frozenset[bytes] | None) -> DataFrame:
    """word, toxic, clean: without a lexicon the texts that hold the word, else its places."""

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = alnum_words(t)
                to = toxic if y else clean
                if lexicon is None:
                    to.update(set(words))
                    to[b""] += 1  # texts
                else:
                    to.update(w for w in words if w in lexicon)
                    to[b""] += len(words)
            words = [*{*toxic, *clean}]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(step, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(rows: DataFrame) -> Model:
    """rows: text and toxic (0 or 1), of bounded number; counted on the executors."""
    counts = _counted(rows, None)
    texts = counts.filter(F.col("word") == F.lit(b"")).first()
    if not texts or not texts.toxic or not texts.clean:
        return Model()
    n1, n0 = texts.toxic, texts.clean
    pseudo = float(PRIOR * n1)  # texts that the prior stands for
    prior = F.lit(pseudo) * (F.col("toxic") + F.col("clean")) / F.lit(float(n1 + n0))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (n1 + pseudo - a)) - F.log(b / (n0 + pseudo - b))
    words = counts.filter((F.col("toxic") >= 3) & (F.length("word") > 0)).select("word", odds.alias("s"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    best = words.filter((F.col("z") >= Z_LEAST) & (F.col("s") > 0)).collect()  # as many as the sample has words at most
    lexicon = {bytes(r.word): r.s for r in best}
    if not lexicon:
        return Model()
    # What share of clean text each word makes, and a cost that keeps clean text's expected score negative
    clean = {bytes(r.word): r.clean for r in _counted(rows, frozenset(lexicon)).collect()}
    total = clean.get(b"", 0)
    shares = [((clean.get(w, 0) + 0.01) / (total + 1), s) for w, s in lexicon.items()]
    m = Model(lexicon, cost=max(0.05, 4 * sum(p * s for p, s in shares)))
    m.lam = _solve_lambda(shares, m.cost)

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(len(w), [s for s, _, _ in segments([(i, lexicon[x]) for i, x in enumerate(w) if x in lexicon], m.cost)]) for w in map(alnum_words, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64())), b.column(1)], names=["n", "s", "toxic"])

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(step, "n bigint, s array<double>, toxic int").collect()
    # K from the mean of the best segments over clean texts: E[lambda * S - ln n] = ln K + Euler's constant
    over = [m.lam * max(r.s, default=0.0) - math.log(r.n) for r in found if not r.toxic and r.n]
    m.k = max(1e-12, math.exp(min(50.0, float(np.mean(over)) - 0.5772156649))) if over else 1.0
    x = np.array([_row(*m.surprise(r.s, r.n)) for r in found])
    m.weights = tuple(_logistic(x, np.array([float(r.toxic) for r in found])).tolist())
    m.trained = True
    return m


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` distinct labelled texts that are not held out."""
    arrow_batches(docs.sparkSession)
    taught = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~held_out())
    hashes = docs.select("doc_id", F.xxhash64("text").alias("th")).join(taught, "doc_id")
    one = hashes.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "th").limit(sample).select("doc_id", "toxic")
    # the sample's ids are at most 16 bytes a row
    return fit(materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __bq_score and __bq_spans (word ranges of toxic passages)."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text = docs.columns.index("text")

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores, spans = [], []
            for t in b.column(text).to_pylist():
                found, good = score(alnum_words(t), m)
                scores.append(found)
                spans.append([[x, y] for _, x, y in good])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*b.schema.names, "__bq_score", "__bq_spans"])

    return docs.mapInArrow(step, f"{schema}, __bq_score double, __bq_spans array<array<bigint>>")


def reject(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without those that score ``least`` or more."""
    return scored(docs, model).filter(F.col("__bq_score") < least).drop("__bq_score", "__bq_spans")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__bq_score").alias("score"), (F.col("__bq_score") >= 0.5).cast("int").alias("predicted"), F.size("__bq_spans").alias("n_passages"))
