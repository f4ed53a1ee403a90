"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Packing depends on lengths alone, and there are at most ``capacity`` distinct
ones, so the plan is made from the histogram of lengths over all pieces, which
is bounded whatever the corpus holds. First the reduction fixes sets that
dominate every other way to place their largest piece, copies at once:

* a piece that nothing fits beside stays alone;
* two pieces that fill a sequence exactly: whatever else may stand beside the
  larger one fits where its partner stood;
* a piece beside which at most one more fits takes the largest that fits.

The rest goes by best fit in decreasing order, again by counts. The plan says,
for each length, which copies (by number) stand in which sequences; pieces get
their number from per-task counts, so no group of equal lengths meets in a
task.

Defined results: null and empty texts are the end id alone; rows that share a
doc_id are separate pieces; an empty table gives an empty result; other columns
are not read. Every piece is placed exactly once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, materialize, read, text_slices
from bitquarry.llm._tokenize import drop_encoder, encoder

CAPACITY = 4096

#: A run: the lengths in one sequence, and how many such sequences there are.
Run = tuple[tuple[int, ...], int]


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Run]:
    """Fixes dominating sets; takes their pieces out of counts."""
    runs: list[Run] = []

    def take(*lengths: int, n: int) -> None:
        runs.append((lengths, int(n)))
        for x in lengths:
            counts[x] -= n

    for j in range(capacity, 0, -1):
        k = capacity - j
        if counts[j] and j == capacity:
            take(j, n=counts[j])
        elif k and counts[j] and counts[k] and k < j:
            take(j, k, n=min(counts[j], counts[k]))
        elif k == j and counts[j] > 1:
            take(j, j, n=counts[j] // 2)
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return runs
        j = int(left[-1])
        counts[j] -= 1  # what may stand beside one of the largest
        fit = np.flatnonzero(counts[: capacity - j + 1])
        smallest = [int(x) for x in fit[:2] for _ in range(2 if counts[x] > 1 else 1)][:2]
        counts[j] += 1
        if not smallest:
            take(j, n=counts[j])
        elif len(smallest) < 2 or j + sum(smallest) > capacity:
            k = int(fit[-1])
            take(j, k, n=counts[j] // 2 if k == j else min(counts[j], counts[k]))
        else:
            return runs


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best fit in decreasing order over counts of lengths."""
    open_: dict[int, list[list]] = {}
    room: list[int] = []  # sorted rooms that are open

    from bisect import bisect_left, insort

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in open_:
            open_[space] = []
            insort(room, space)
        for x in open_[space]:
            if x[0] == pattern:
                x[1] += n
                return
        open_[space].append([pattern, n])

    runs: list[Run] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = bisect_left(room, length)
            if at == len(room):
                each = capacity // length
                full, n = divmod(n, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if n:
                    put(capacity - n * length, (length,) * n, 1)
                n = 0
                continue
            space = room[at]
            pattern, have = open_[space].pop()
            if not open_[space]:
                del open_[space]
                room.pop(at)
            each = min(space // length, n)  # the same sequence stays the best fit until it is full
            fill = min(have, n // each)
            if have > fill:
                put(space, pattern, have - fill)
            put(space - each * length, pattern + (length,) * each, fill)
            n -= fill * each
    for stacks in open_.values():
        runs += [(p, n) for p, n in stacks]
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError("lengths from 1 to the capacity")
        counts[length] = n
    return [r for r in reduce_dominated(counts, capacity) + best_fit(counts, capacity) if r[1]]


def slots(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which copy on, which sequence comes first, at which offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            found.setdefault(x, []).append((first, sequence, offset))
            used[x] = first + n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in found.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and each piece's number among those of its length in its task."""
    arrow_batches(docs.sparkSession)

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer, keeps_space)
        numbers: dict[int, int] = {}
        for whole in batches:
            for b in text_slices(whole, 1, 1 << 20):
                pa.default_memory_pool().release_unused()
                ids, starts = enc.encode_batch(b.column(1), end_id)
                raw = memoryview(ids.astype("<u4")).cast("B")
                rows: list[tuple] = []
                for d, x, y in zip(b.column(0).to_pylist(), starts.tolist(), starts[1:].tolist()):
                    for k in range(x, y, capacity):
                        n = min(capacity, y - k)
                        number = numbers.get(n, 0)
                        numbers[n] = number + 1
                        rows.append((d, (k - x) // capacity, k - x, n, zlib.crc32(raw[4 * k : 4 * (k + n)]), task, number))
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])
        drop_encoder()  # 60 MB or more, in every worker that ever packed, beside what later steps take

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, keeps_space: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    cut = materialize(pieces(docs, tokenizer, end_id, keeps_space, capacity))
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(histogram, capacity))
    held = docs.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(3).to_numpy()
            number = b.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, seq, off = held.value[x]
                k = np.searchsorted(first, number[at], "right") - 1
                sequence[at], offset[at] = seq[k] + number[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"))
    return numbered.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer or word_tokenizer())
