"""Language identification by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every run of characters that aren't letters becomes one
space, and the n-grams of 1 to 4 characters of what is left are hashed into
buckets. Learning counts the buckets of each language on the executors (each
task adds up its own first) over a sample of labelled texts; the log-probability
matrix is broadcast and scores whole batches with numpy: every n-gram of every
text picks its row of the matrix, and the rows of a text are added up.

Log-probabilities are integers (multiples of 1/4096), so sums are exact and the
same under any batching. The four orders overlap, so their sum is divided by
four before the classes' shares are added and the posterior is taken.

Bounds: about ``SAMPLE`` labelled texts a language teach (drawn by a hash of
doc_id with the share that the language's exact count calls for); buckets times
languages is at most ``CELLS``, which bounds the broadcast at 16 MB.

Defined results: null text and text without a letter are ``und`` with score 0,
and so is every text where nothing was learned; rows whose text, lang or doc_id
is null teach nothing; repeated rows teach and are answered each; a tie goes to
the language whose name sorts first; an empty table gives an empty result;
other columns are kept by ``identified`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, mix, read, text_bytes, text_slices

SAMPLE = 20_000
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
CELLS = 1 << 22
SMOOTH = 0.1
UNIT = 4096
UNKNOWN = "und"
#: characters whose n-grams are looked up at once
_AT_ONCE = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  # a row for each bucket and one of zeros, a column for each language: log-probabilities in units
    prior: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.matrix) - 1


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with one space for each run of others; where each text begins (one more than texts)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, _ = text_bytes(low)
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) if len(low) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run
    firsts = offsets[:-1][lengths > 0]
    keep[firsts] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, points, np.uint32(32))[keep], places[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; ``buckets`` where the text ends before the n-gram does."""
    n = len(points)
    out = np.full(n, buckets, np.int32)
    if n < order:
        return out
    with np.errstate(over="ignore"):
        h = np.full(n - order + 1, np.uint64(order))
        for k in range(order):
            h = (h * _FACTOR) ^ points[k : n - order + 1 + k]
        out[: n - order + 1] = (mix(h) & np.uint64(buckets - 1)).astype(np.int32)
    for back in range(1, order):
        at = offsets[1:] - back
        out[at[at >= offsets[:-1]]] = buckets
    return out


def scores(points: np.ndarray, offsets: np.ndarray, m: Model) -> np.ndarray:
    """The sum of log-probabilities of each text's n-grams in each language, in units."""
    out = np.zeros((len(offsets) - 1, len(m.langs)), np.int64)
    step = max(4096, _AT_ONCE // len(m.langs))
    indices = [grams(points, offsets, order, m.buckets) for order in ORDERS]
    for a in range(0, len(points), step):
        b = min(len(points), a + step)
        rows = sum(m.matrix[i[a:b]] for i in indices)
        first = int(np.searchsorted(offsets, a, "right")) - 1
        last = int(np.searchsorted(offsets, b, "left"))
        cuts = np.clip(offsets[first:last], a, b) - a
        held = np.flatnonzero(np.diff(np.append(cuts, b - a)) > 0)
        out[first + held] += np.add.reduceat(rows, cuts[held], axis=0, dtype=np.int64)
    return out


def predict(texts: pa.Array, m: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    n = len(texts)
    if m is None or not n:
        return [UNKNOWN] * n, np.zeros(n)
    points, offsets = letters_of(texts)
    some = np.concatenate([[0], np.cumsum(points != 32)])
    known = some[offsets[1:]] > some[offsets[:-1]]
    z = scores(points, offsets, m) / (UNIT * len(ORDERS)) + m.prior
    best = z.argmax(1)
    share = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
    return [m.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())], np.where(known, share, 0.0)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of rows (doc_id, text, lang), of which about ``sample`` a language are drawn."""
    spark = rows.sparkSession
    arrow_batches(spark)
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null")
    sizes = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    if not sizes:
        return None
    langs = [lang for lang, _ in sizes]
    buckets = BUCKETS
    while buckets * len(langs) > CELLS and buckets > 2:
        buckets //= 2
    least = spark.createDataFrame([(lang, i, min(1.0, sample / n)) for i, (lang, n) in enumerate(sizes)], "lang string, at int, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(least), "lang").filter(draw < F.col("share")).select("text", "at")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in text_slices(whole, 0):
                points, offsets = letters_of(b.column(0))
                at = np.repeat(b.column(1).to_numpy(), np.diff(offsets))
                for order in ORDERS:
                    found = grams(points, offsets, order, buckets)
                    for k in np.unique(at).tolist():
                        one = np.bincount(found[at == k], minlength=buckets + 1)[:buckets]
                        held[k] = held[k] + one if k in held else one
        for k, c in held.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["at", "bucket", "n"])

    counted = drawn.mapInArrow(count, "at int, bucket int, n bigint").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    counts = np.zeros((buckets, len(langs)))
    counts[counted.column("bucket").to_numpy(), counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    logs = np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * buckets)
    matrix = np.concatenate([np.rint(logs * UNIT), np.zeros((1, len(langs)))]).astype(np.int32)
    shares = np.array([n for _, n in sizes], float)
    return Model(langs, matrix, np.log(shares / shares.sum()))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with __bq_lang and __bq_score."""
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # CELLS integers at most
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text = docs.columns.index("text")

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, text):
                lang, score = predict(b.column(text), held.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, "__bq_lang", "__bq_score"])

    return docs.mapInArrow(step, f"{schema}, __bq_lang string, __bq_score double")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(held_out(), F.lit(False))
    out = identified(docs.select("doc_id", "text"), fit(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), F.col("__bq_lang").alias("lang_pred"), F.col("__bq_score").alias("score"))
