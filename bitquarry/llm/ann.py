"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means whose clusters are held
near equal size. Every vector goes to its nearest centroid's list, and to
further lists (``REPLICAS`` at most) whose centroid is almost as near
(``BOUNDARY``) and not too close to one of a list it is in already
(``SPREAD``), so replicas lie on different sides of a boundary. Queries search the centroids by a best-first walk over their
nearest-neighbour graph, held in memory, and read the lists whose distance is
within a ratio of the best.

Largest inner product becomes nearest point by one more dimension, which makes
all vectors equally long. Lists are dealt to tasks in blocks of bounded size
(a block number from the vector's hash), so a list that holds a third of all
rows is many tasks; a block's best are merged per query.

How many lists a query reads is fitted too: for some vectors of the sample, the
lists of their exact neighbours in the sample say how far down the query's
order of centroids ``TARGET`` of the neighbours are reached. Vectors without
cluster structure need many lists, and get them.

Index: all rows; the sample (``SAMPLE``) only places centroids and fits that
number. Scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite components take no part; candidates are all rows but
the query's own vec_id; repeated vec_ids count once, with their first vector
in order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, materialize, read

SAMPLE = 20_000
LIST_ROWS = 300
MOST_LISTS = 2_000
REPLICAS = 3
BOUNDARY = 1.3
SPREAD = 0.25
TARGET = 0.95
RATIO = 2.0
TRIALS = 200
#: lists are read past the ratio until they hold so many times what is asked for
ENOUGH = 2
BLOCK_ROWS = 4_000
EVERY = 20
TOP = 20


def fit(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids of x; clusters that grow beyond the mean are made costlier."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    weight = np.zeros(k)
    scale = float(np.mean(np.var(x, axis=0))) * x.shape[1]
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * (x @ c.T) + weight[None]
        own = d.argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = size > 0
        c[full] = sums[full] / size[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        weight += 0.1 * scale * (size * k / len(x) - 1)
        weight = np.clip(weight - weight.mean(), -0.3 * scale, 0.3 * scale)
    return c


class Graph:
    """Nearest-neighbour graph of the centroids with a best-first search."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        self.norm = (c * c).sum(1)
        d = self.norm[None] - 2 * (c @ c.T)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(degree, len(c) - 1)]
        links = [set(row.tolist()) for row in near]
        for a, row in enumerate(near.tolist()):
            for b in row:
                links[b].add(a)
        for a in range(len(c) - 1):  # a ring besides, so that every centroid can be reached
            links[a].add(a + 1)
            links[a + 1].add(a)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        step = max(1, len(c) // 16)
        self.doors = np.arange(0, len(c), step)

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest centroids found, nearest first, and their squared distances."""
        qq = float(q @ q)
        seen = np.zeros(len(self.c), bool)
        dist = self.norm[self.doors] - 2 * (self.c[self.doors] @ q) + qq
        seen[self.doors] = True
        heap = sorted(zip(dist.tolist(), self.doors.tolist()))
        best = [(-d, a) for d, a in heap[:n]]
        heapq.heapify(best)
        while heap:
            d, a = heapq.heappop(heap)
            if len(best) >= n and d > -best[0][0]:
                break
            new = self.links[a][~seen[self.links[a]]]
            if not len(new):
                continue
            seen[new] = True
            for d2, b in zip((self.norm[new] - 2 * (self.c[new] @ q) + qq).tolist(), new.tolist()):
                if len(best) < n or d2 < -best[0][0]:
                    heapq.heappush(heap, (d2, b))
                    heapq.heappush(best, (-d2, b))
                    if len(best) > n:
                        heapq.heappop(best)
        out = sorted((-d, a) for d, a in best)
        return np.array([a for _, a in out], np.int64), np.maximum(0.0, np.array([d for d, _ in out]))


class Index:
    def __init__(self, c: np.ndarray, longest: float):
        self.c, self.longest, self.reads = c, longest, len(c)
        self.graph = Graph(c)
        self.between = np.maximum(0.0, self.graph.norm[:, None] - 2 * (c @ c.T) + self.graph.norm[None])

    def points(self, x: np.ndarray) -> np.ndarray:
        """x with the dimension that makes all vectors equally long."""
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1)

    def lists(self, x: np.ndarray) -> list[list[int]]:
        """The posting lists that each vector goes to."""
        p = self.points(x)
        d = np.maximum(0.0, (p * p).sum(1)[:, None] + self.graph.norm[None] - 2 * (p @ self.c.T))
        n = min(4 * REPLICAS, len(self.c))
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        out = []
        for row, dist in zip(near, d):
            row = row[np.argsort(dist[row], kind="stable")]
            kept = [int(row[0])]
            most = BOUNDARY**2 * dist[row[0]]
            for a in row[1:].tolist():
                if dist[a] > most or len(kept) >= REPLICAS:
                    break
                if all(self.between[a, b] > SPREAD * dist[a] for b in kept):
                    kept.append(a)
            out.append(kept)
        return out

    def probes(self, q: np.ndarray, n: int | None = None, sizes: np.ndarray | None = None, top: int = TOP) -> np.ndarray:
        """The lists that a query reads, nearest first. The query has the length of the longest vector, as the points have. sizes: of each list."""
        length = math.sqrt(float(q @ q))
        point = np.concatenate([q * (self.longest / length), [0.0]])
        a, d = self.graph.search(point, min(n or self.reads, len(self.c)))
        near = int((d <= RATIO**2 * d[0]).sum())
        if sizes is None:
            return a[:near]
        while True:  # a list or two may hold next to nothing: on down the order until there is enough
            held = np.cumsum(sizes[a])
            enough = int(np.searchsorted(held, ENOUGH * (REPLICAS * top + 1))) + 1
            if enough <= len(a) or len(a) == len(self.c):
                return a[: max(near, enough)]
            a, d = self.graph.search(point, min(2 * len(a), len(self.c)))

    def tune(self, x: np.ndarray, top: int) -> None:
        """Sets how many lists a query reads, from exact neighbours inside a sample."""
        lists = self.lists(x)
        need = []
        for i in range(0, len(x), max(1, len(x) // TRIALS)):
            score = x @ x[i]
            score[i] = -np.inf
            place = np.full(len(self.c), len(self.c))
            order = self.probes(x[i], len(self.c))
            place[order] = np.arange(len(order))
            need += [int(place[lists[j]].min()) + 1 for j in np.argsort(-score)[: min(top, len(x) - 1)].tolist()]
        if need:
            self.reads = min(len(self.c), max(8, int(np.quantile(need, TARGET)) + 1))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64) if len(col) else np.zeros((0, width))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and v (array of double) of the rows that take part, and their length."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 0
    return good.filter(F.size("v") == width), width


def build(good: DataFrame, width: int, sample: int = SAMPLE) -> Index:
    """Centroids from a bounded sample: the rows of smallest hash."""
    n = good.count()
    longest = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x = np.array(rows["v"].tolist(), np.float64)
    index = Index(np.zeros((1, width + 1)), math.sqrt(longest) * (1 + 1e-9))
    p = index.points(np.unique(x, axis=0))
    k = max(1, min(MOST_LISTS, math.ceil(n / LIST_ROWS), len(p)))
    index = Index(fit(p, k), index.longest)
    index.tune(x, TOP)
    return index


_OUT = "query_id bigint, vec_id bigint, score double"


def _best(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best vectors for each query: highest score, then smallest vec_id."""
    out: list[tuple] = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        for row, i, v in zip(s, qid[a : a + 256].tolist(), q[a : a + 256]):
            row = np.where(xid == i, -np.inf, row)
            if len(row) > top:
                edge = np.partition(row, len(row) - top)[len(row) - top]
                at = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
            else:
                at = np.arange(len(row))
            at = at[np.isfinite(row[at])]
            # summed the same way for every vector, so equal vectors have equal scores in any block
            exact = (x[at] * v).sum(1)
            best = np.lexsort((xid[at], -exact))[:top]
            out.append((np.full(len(best), i), xid[at][best], exact[best]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for queries with vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    arrow_batches(spark, 2000)
    good, width = usable(vectors)
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = materialize(good.groupBy("vec_id").agg(F.min("v").alias("v")))
    index = build(good, width)
    held = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = held.value.lists(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

    @lean
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = [held.value.probes(q, None, sized.value, top).tolist() for q in _matrix(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

    spec = "vec_id bigint, v array<double>, lists array<int>"
    postings = materialize(good.mapInArrow(place, spec))
    sizes = postings.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    blocks = {r.list: max(1, -(-r.n // BLOCK_ROWS)) for r in sizes.collect()}  # MOST_LISTS rows at most
    rows_of = np.zeros(len(index.c), np.int64)
    for r in sizes.collect():
        rows_of[r.list] = r.n
    sized = spark.sparkContext.broadcast(rows_of)
    count = F.create_map(*[F.lit(x) for kv in sorted(blocks.items()) for x in kv]) if blocks else None
    members = postings.select(F.explode("lists").alias("list"), "vec_id", "v").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(count, F.col("list"))).cast("int"))
    queries = good.filter(F.col("vec_id") % every == 0).mapInArrow(ask, spec)
    asked = queries.select(F.explode("lists").alias("list"), F.col("vec_id").alias("query_id"), "v").filter(F.col("list").isin(sorted(blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(count, F.col("list")).cast("int") - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(a.column("v").combine_chunks(), width), _matrix(b.column("v").combine_chunks(), width)
        i, j, s = _best(q, x, a.column("query_id").to_numpy(), b.column("vec_id").to_numpy(), top)
        return pa.table({"query_id": i, "vec_id": j, "score": s})

    found = asked.groupBy("list", "block").cogroup(members.groupBy("list", "block")).applyInArrow(meet, _OUT)
    # one best list for each query: an ordered list of bounded length
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, top).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("k", "b")).select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.d")).alias("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
