"""Centroid clustering with Elkan's bounds, in exact integers.

Each component x becomes floor(``SCALE`` * x). Every vector keeps an upper
bound of its distance to its own centroid and a lower bound of that to each of
the k centroids; the bounds are written with the vectors after each round and
move with the centroids. A centroid is looked at for a vector only if neither
its lower bound nor half its distance from the vector's own centroid exceeds
the upper bound. The comparison is strict, lower bounds are rounded down and
upper ones up, so a centroid as near as the own one is always looked at, and
ties go to the smaller number. What is looked at is computed in integers, and
so are sums and means; a bound saves work and never decides.

A round is one job: tasks assign their vectors, then add up their own sums for
each cluster; k sums reach the driver and k centroids go back. The vectors stay
on the executors, and what a round reads is a written table.

Defined results: vectors that are null, of another length than ``DIMS``, or
with null or non-finite components take no part; nor do those with a component
beyond ``LARGEST`` in size, whose squared distances need not fit a long.
Repeated rows are clustered each; of rows with an equal hash the one whose
components are smaller begins a cluster first, and rows without a vec_id come
last; with fewer than k vectors each begins one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, drop_folder, lean, materialize, read

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
LARGEST = 1 << 27
#: floats of eight bytes hold all integers up to here
_EXACT = 1 << 53


def _down(x: np.ndarray) -> np.ndarray:
    """Floats of four bytes that are not above x (zero at least)."""
    return np.nextafter(np.maximum(x * (1 - 2.0**-48), 0.0).astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 2.0**-48)).astype(np.float32), np.float32(np.inf))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from c (one row, or one for each row of x)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < _EXACT:
        d = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x - c
    return (d * d).sum(1)


@dataclass
class Centroids:
    at: np.ndarray  # k x dims, integers
    moved: np.ndarray  # how far each moved since the bounds were written, rounded up
    between: np.ndarray = field(init=False)  # half the distance of each pair, rounded down

    def __post_init__(self):
        k = len(self.at)
        apart = np.array([squares(self.at, self.at[j]) for j in range(k)], np.float64).reshape(k, k)
        self.between = _down(np.sqrt(apart) / 2)


def assign(x: np.ndarray, c: Centroids, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid, exact squared distance, bounds for the next round, and how many distances were computed besides the own ones."""
    n, k = len(x), len(c.at)
    own, lower = own.copy(), lower.copy()
    np.maximum(_down(np.maximum(lower.astype(np.float64) - c.moved, 0.0)), 0, out=lower)
    upper = _up(upper.astype(np.float64) + c.moved[own])
    exact = squares(x, c.at[own]) if n else np.zeros(0, np.int64)  # the result wants it of every vector
    root = np.sqrt(exact.astype(np.float64))
    upper, rows = np.minimum(upper, _up(root)), np.arange(n)
    lower[rows, own] = _down(root)
    looked = 0
    for j in range(k):
        near = np.flatnonzero((own != j) & ~(lower[:, j] > upper) & ~(c.between[own, j] > upper))
        if not len(near):
            continue
        looked += len(near)
        found = squares(x[near], c.at[j])
        root = np.sqrt(found.astype(np.float64))
        lower[near, j] = _down(root)
        better = (found < exact[near]) | ((found == exact[near]) & (j < own[near]))
        to = near[better]
        own[to], exact[to], upper[to] = j, found[better], _up(root[better])
    return own, exact, upper, lower, looked


def vectors_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as integers."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # null is nan
    good = (np.abs(flat) <= LARGEST / SCALE).all(1)  # nan and infinite are not
    scaled = np.floor(SCALE * flat[good]).astype(np.int64)
    return fit[good], scaled


def _ints(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v (integers) of the vectors that take part."""

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors_of(b.column(1), dims)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _ints(x)], names=["vec_id", "v"])

    arrow_batches(vectors.sparkSession, 2000)
    return vectors.select("vec_id", "embedding").mapInArrow(step, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>")


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and vec_id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def sums(assigned: DataFrame, k: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, componentwise sum and summed distance of each cluster; a task adds up its own first."""

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 2), np.int64)
        for b in batches:
            own = b.column(1).to_numpy()
            x = np.column_stack([np.ones(len(own), np.int64), b.column(2).to_numpy(), _matrix(b.column(0), dims)]) if len(own) else np.zeros((0, dims + 2), np.int64)
            order = np.argsort(own, kind="stable")
            found, starts = np.unique(own[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(x[order], starts, axis=0)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "s"])

    parts = assigned.select("v", "cluster", "distance").mapInArrow(step, "cluster int, s array<bigint>")
    out = np.zeros((k, dims + 2), np.int64)
    for r in parts.select("cluster", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():  # k * (dims + 2) rows
        out[r.cluster, r.i] = r.x
    return out[:, 0], out[:, 2:], out[:, 1]


def _step(rows: DataFrame, centroids: Centroids, dims: int, first: bool) -> DataFrame:
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(centroids)  # k centroids
    k = len(centroids.at)
    kind = rows.schema["vec_id"].dataType.simpleString()

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            x = _matrix(b.column(1), dims).astype(np.int64)
            n = len(x)
            if first:
                own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
            else:
                own, upper, lower = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy(), _matrix(b.column(5), k)
            own, exact, upper, lower, looked = assign(x, c, own, upper, lower)
            bounds = pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), k).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(exact), pa.array(upper), bounds], names=["vec_id", "v", "cluster", "distance", "upper", "lower"])

    return rows.mapInArrow(step, f"vec_id {kind}, v array<int>, cluster int, distance bigint, upper float, lower array<float>")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """vec_id, v, cluster and distance of each vector that takes part; the final centroids; each cluster's summed distance."""
    rows = materialize(kept(vectors, dims))
    at = first_centroids(rows, k, seed)
    if not len(at):
        empty = rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("bigint")})
        return empty, np.zeros((0, dims), np.int64), np.zeros(0, np.int64)
    moved = np.zeros(len(at))
    state = rows
    for i in range(rounds + 1):
        after = materialize(_step(state, Centroids(at, moved), dims, first=i == 0))
        drop_folder(state)
        state = after
        n, total, inertia = sums(state, len(at), dims)
        if i < rounds:
            mean = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], at)  # floor, also below zero
            moved = _up(np.sqrt(squares(mean, at).astype(np.float64))).astype(np.float64)
            at = mean
    return state.select("vec_id", "v", "cluster", "distance"), at, inertia


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at, inertia = cluster(read(spark, sf_dir, "embeddings"))
    about = [(j, int(inertia[j]), int(inertia.sum()), digest(c)) for j, c in enumerate(at)]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(rounds: int) -> str:
    out = []
    for i in range(rounds + 1):
        out.append(f"""
a{i} AS MATERIALIZED (
    SELECT r, cluster, distance FROM (
        SELECT r, cluster, distance, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS nearest FROM (
            SELECT q.r, c.cluster, CAST(sum((q.x - c.x) * (q.x - c.x)) AS BIGINT) AS distance FROM q JOIN c{i} c ON q.i = c.i GROUP BY 1, 2
        )
    ) WHERE nearest = 1
)""")
        if i < rounds:
            out.append(f"""
m{i} AS MATERIALIZED (SELECT a.cluster, q.i, CAST(sum(q.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN q ON a.r = q.r GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.i = c.i
)""")
    return ",".join(out)


#: The same rows by brute force: every vector against every centroid, component by component.
ORACLE_SQL = f"""
WITH g AS MATERIALIZED (
    SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), q AS MATERIALIZED (
    SELECT r, vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM g, range(1, {DIMS + 1}) t(i)
), c0 AS MATERIALIZED (
    SELECT o.cluster, q.i, q.x FROM (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM g) o JOIN q ON q.r = o.r WHERE o.cluster < {K}
), {_rounds(ROUNDS)},
f AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)
SELECT g.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
    CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, f.centroid_sha256
FROM a{ROUNDS} a JOIN g ON g.r = a.r JOIN f ON f.cluster = a.cluster
"""
