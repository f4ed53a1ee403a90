"""Clustering and factor baselines.

Sequential rules (DP-means, leader, summaries, sequential k-means, BP-means)
depend on order, so one stream is one task and streams are groups; each takes
vectors as arrays. Batch k-means, LDA and silhouettes are Spark ML's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dp_means(x: np.ndarray, lam: float) -> np.ndarray:
    """One pass: the nearest centre within squared distance lam, or a new centre at the point; centres are running means."""
    centres, counts, labels = np.empty((0, x.shape[1])), [], []
    for p in x:
        if len(centres):
            d = ((centres - p) ** 2).sum(1)
            k = int(d.argmin())
            if d[k] <= lam:
                counts[k] += 1
                centres[k] += (p - centres[k]) / counts[k]
                labels.append(k)
                continue
        centres = np.vstack([centres, p])
        counts.append(1)
        labels.append(len(centres) - 1)
    return np.array(labels, int)


def leader(x: np.ndarray, radius: float, first: bool = False) -> np.ndarray:
    """The nearest (or first) leader within radius, or the point leads; leaders never move."""
    leaders, labels = np.empty((0, x.shape[1])), []
    for p in x:
        d = np.sqrt(((leaders - p) ** 2).sum(1))
        near = np.flatnonzero(d <= radius)
        if len(near):
            labels.append(int(near[0] if first else d.argmin()))
        else:
            leaders = np.vstack([leaders, p])
            labels.append(len(leaders) - 1)
    return np.array(labels, int)


def summaries(x: np.ndarray, radius: float, most: int = 50) -> np.ndarray:
    """Clusters as (count, sum, squared norm): a point joins if the cluster's radius stays small; beyond ``most`` the nearest two join."""
    n, s, q = np.empty(0), np.empty((0, x.shape[1])), np.empty(0)
    ids, parent, labels, last = [], {}, [], 0
    for p in x:
        k = -1
        if len(n):
            k = int(((s / n[:, None] - p) ** 2).sum(1).argmin())
            m = n[k] + 1
            spread = (q[k] + p @ p) / m - (((s[k] + p) / m) ** 2).sum()
            if spread > radius**2:
                k = -1
        if k < 0:
            n, s, q = np.append(n, 0.0), np.vstack([s, np.zeros(x.shape[1])]), np.append(q, 0.0)
            ids.append(last)
            last += 1
            k = len(n) - 1
        n[k] += 1
        s[k] += p
        q[k] += p @ p
        labels.append(ids[k])
        if len(n) > most:
            c = s / n[:, None]
            d = ((c[:, None] - c[None]) ** 2).sum(2)
            np.fill_diagonal(d, np.inf)
            a, b = sorted(np.unravel_index(d.argmin(), d.shape))
            n[a], s[a], q[a] = n[a] + n[b], s[a] + s[b], q[a] + q[b]
            parent[ids[b]] = ids[a]
            n, s, q = np.delete(n, b), np.delete(s, b, 0), np.delete(q, b)
            del ids[b]

    def root(k: int) -> int:
        while k in parent:
            k = parent[k]
        return k

    return np.array([root(k) for k in labels], int)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres, each drawn by squared distance to those before."""
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = np.min([((x - a) ** 2).sum(1) for a in c], axis=0)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(c, float)


def sequential_kmeans(x: np.ndarray, k: int, seed: int = 0, spread_out: bool = False) -> np.ndarray:
    """MacQueen's rule: the nearest of k centres, which moves by 1 / count; centres start at the first points, or spread out."""
    c = plus_plus(x, k, np.random.default_rng(seed)) if spread_out else x[:k].astype(float).copy()
    counts, labels = np.ones(len(c)), []
    for p in x:
        j = int(((c - p) ** 2).sum(1).argmin())
        counts[j] += 1
        c[j] += (p - c[j]) / counts[j]
        labels.append(j)
    return np.array(labels, int)


def bp_means(x: np.ndarray, lam2: float, most: int = 40, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Binary memberships Z and features A that minimise |x - ZA|^2 + lam2 K, by coordinate passes."""
    n, d = x.shape
    z, a = np.ones((n, 1)), x.mean(0, keepdims=True)
    before = np.inf
    for _ in range(rounds):
        for i in range(n):
            for k in range(z.shape[1]):
                rest = x[i] - z[i] @ a + z[i, k] * a[k]
                z[i, k] = float(((rest - a[k]) ** 2).sum() < (rest**2).sum())
            rest = x[i] - z[i] @ a
            if rest @ rest > lam2 and z.shape[1] < most:
                z = np.hstack([z, np.zeros((n, 1))])
                z[i, -1] = 1
                a = np.vstack([a, rest])
        used = z.any(0)
        z = z[:, used]
        a = np.linalg.solve(z.T @ z + 1e-6 * np.eye(z.shape[1]), z.T @ x) if z.shape[1] else np.zeros((0, d))
        now = ((x - z @ a) ** 2).sum() + lam2 * z.shape[1]
        if before - now < 1e-9:
            break
        before = now
    return z, a


def heuristic_lam(x: np.ndarray, k: int) -> float:
    """Farthest-first traversal: the squared distance at which the (k + 1)-th point would come."""
    d = ((x - x.mean(0)) ** 2).sum(1)
    for _ in range(k):
        p = x[int(d.argmax())]
        d = np.minimum(d, ((x - p) ** 2).sum(1))
    return float(d.max())


def fit_groups(vectors: DataFrame, by: str, fit, order: str = "rec_id") -> DataFrame:
    """(by, rec_id, v) to (by, rec_id, label): fit(matrix) for each group in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.array(pdf["v"].tolist(), float)
        return pd.DataFrame({by: pdf[by], "rec_id": pdf["rec_id"], "label": np.asarray(fit(x), np.int64)})

    kind = vectors.schema[by].dataType.simpleString()
    return vectors.groupBy(by).applyInPandas(run, f"{by} {kind}, rec_id bigint, label bigint")


def multi_hot(cells: DataFrame, least: int = 1) -> tuple[DataFrame, list[str]]:
    """rec_id, v (unit vector over key=value and key indicators with ``least`` records); for schemas that fit a vector."""
    both = cells.select("rec_id", F.concat_ws("=", "key", "value").alias("f")).unionByName(cells.select("rec_id", F.concat(F.lit("KEY:"), "key").alias("f"))).distinct()
    names = [r.f for r in both.groupBy("f").count().filter(F.col("count") >= least).select("f").orderBy("f").collect()]  # one row for each feature of the vector
    index = F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (f, i)])
    on = both.filter(F.element_at(index, F.col("f")).isNotNull()).groupBy("rec_id").agg(F.array_sort(F.collect_set(F.element_at(index, F.col("f")))).alias("on"))
    v = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.when(F.array_contains("on", i), 1.0).otherwise(0.0) / F.sqrt(F.size("on").cast("double")))
    return on.select("rec_id", v.alias("v")), names


def kmeans(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """rec_id, label by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("rec_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("rec_id", F.col("prediction").cast("long").alias("label"))


def kmeans_by_silhouette(vectors: DataFrame, ks: list[int], seed: int = 0) -> tuple[int, float]:
    """The k of the best silhouette, and that."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")).cache()
    scores = [(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(x).transform(x)), -k) for k in ks]
    x.unpersist()
    best = max(scores)
    return -best[1], best[0]


def tfidf(texts: DataFrame, column: str, features: int = 1 << 14) -> DataFrame:
    """texts with tfidf vectors of their words, by Spark ML."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    words = RegexTokenizer(inputCol=column, outputCol="__w", pattern="[\\W_]+", minTokenLength=2).transform(texts)
    tf = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features).transform(words)
    return Normalizer(inputCol="__idf", outputCol="features").transform(IDF(inputCol="__tf", outputCol="__idf").fit(tf).transform(tf)).drop("__w", "__tf", "__idf")


def threshold_pairs(vectors: DataFrame, least: float, by: str) -> DataFrame:
    """a < b: vectors of one block (column by) with cosine of at least ``least``."""
    from bitquarry.functions.text import cosine

    a, b = vectors.select(F.col("rec_id").alias("a"), F.col("v").alias("x"), by), vectors.select(F.col("rec_id").alias("b"), F.col("v").alias("y"), by)
    return a.join(b, by).filter("a < b").filter(cosine("x", "y") >= least).select("a", "b")


def connected_labels(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: minimum labels spread over the edges, with pointer jumping, until nothing changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
    for _ in range(most):
        near = both.join(labels.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        step = labels.join(near, "u").select("u", F.least("root", "m").alias("root"))
        jump = step.select(F.col("u").alias("r"), F.col("root").alias("rr"))
        new = step.join(jump, step["root"] == jump["r"], "left").select("u", F.coalesce("rr", "root").alias("root")).checkpoint()
        changed = new.join(labels.withColumnRenamed("root", "old"), "u").filter("root <> old").limit(1).count()
        labels = new
        if not changed:
            break
    return labels.select(F.col("u").alias("node"), "root")


def soft_cover(weights: DataFrame, cut: float = 0.5) -> DataFrame:
    """rec_id, group of soft weights (rec_id, group, w): all within ``cut`` of the record's largest, or that one."""
    top = weights.groupBy("rec_id").agg(F.max("w").alias("m"), F.min_by("group", F.struct(-F.col("w"), "group")).alias("best"))
    return weights.join(top, "rec_id").filter(((F.col("m") > 0) & (F.col("w") >= cut * F.col("m"))) | (F.col("group") == F.col("best"))).select("rec_id", "group")


def elbow(losses: DataFrame) -> DataFrame:
    """k with the greatest second difference of (k, loss): a table of the few k tried."""
    from pyspark.sql import Window

    w = Window.orderBy("k")
    d = losses.withColumn("bend", F.lag("loss").over(w) - 2 * F.col("loss") + F.lead("loss").over(w))
    return d.filter("bend IS NOT NULL").agg(F.min_by("k", F.struct(-F.col("bend"), "k")).alias("k"))
