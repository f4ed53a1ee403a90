"""Codes of values that know how alike values are: vectors (value, vector) beside cells.

A value's similarity to those already seen in its block can cheapen its name.
The semantic code is mixed with the plain one, so it never costs more than a
bit beyond it; values without a vector are coded plainly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.functions.text import cosine

#: Sharpness of the softmax arms, mixed with equal weight.
BETAS = (0.5, 1.0, 2.0, 4.0, 8.0)


def naming_bits(first_seen: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, value, at, plain, semantic, mixed: bits of each new value's name.

    first_seen: (key, value, at), the order in which a key's values came. The
    inventory is the key's values, so pairs stay inside a key's inventory.
    """
    v = vectors.select("value", "vector")
    inv = first_seen.join(v, "value", "left")
    n = first_seen.groupBy("key").agg(F.count("*").alias("m"))
    new, seen, name = inv.alias("new"), inv.alias("seen"), inv.alias("name")
    # nearest seen value of every value that is still without a name, as each new one comes
    still = new.select(F.col("key"), F.col("value").alias("coming"), F.col("at").alias("now")).join(name.select("key", F.col("value").alias("other"), F.col("at").alias("later"), F.col("vector").alias("x")), "key").filter("later >= now")
    near = still.join(seen.select("key", F.col("at").alias("before"), F.col("vector").alias("y")), "key").filter("before < now").groupBy("key", "coming", "now", "other").agg(F.min(1 - cosine("x", "y")).alias("d"))
    weights = near.select("key", "coming", "now", "other", *[F.exp(-b * F.col("d")).alias(f"w{i}") for i, b in enumerate(BETAS)])
    sums = weights.groupBy("key", "coming", "now").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(BETAS))], *[F.max(F.when(F.col("other") == F.col("coming"), F.col(f"w{i}"))).alias(f"o{i}") for i in range(len(BETAS))])
    mean = sum((F.col(f"o{i}") / F.col(f"s{i}") for i in range(len(BETAS))), F.lit(0.0)) / len(BETAS)
    j = first_seen.join(n, "key").join(sums.withColumnRenamed("coming", "value").withColumnRenamed("now", "at"), ["key", "value", "at"], "left")
    plain = F.log2(F.col("m") + 1)
    semantic = F.coalesce(-F.log2(mean * F.col("m") / (F.col("m") + 1)), plain)
    return j.select("key", "value", "at", plain.alias("plain"), semantic.alias("semantic"), B.mixture_bits(plain, semantic).alias("mixed"))


def kernel(vectors: DataFrame, sharpness: float = 2.0) -> DataFrame:
    """a, b, k: max(0, cosine) ** sharpness between an inventory's values, 1 on the diagonal."""
    a, b = vectors.select(F.col("value").alias("a"), F.col("vector").alias("x")), vectors.select(F.col("value").alias("b"), F.col("vector").alias("y"))
    return a.crossJoin(b).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.pow(F.greatest(F.lit(0.0), cosine("x", "y")), F.lit(sharpness))).alias("k"))  # an inventory's values only


def smoothed_bits(counts: DataFrame, k: DataFrame, alpha: float = 0.5) -> DataFrame:
    """value, bits: the next value's code from counts (value, c) smoothed over a kernel."""
    m = counts.count()
    s = counts.join(k, counts["value"] == k["b"]).groupBy("a").agg(F.sum(F.col("c") * F.col("k")).alias("s"))
    total = s.agg(F.sum("s").alias("t"))
    return s.crossJoin(F.broadcast(total)).select(F.col("a").alias("value"), (-F.log2((F.col("s") + alpha) / (F.col("t") + alpha * m))).alias("bits"))  # one row


def centroid_cosine(cells: DataFrame, vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """key_a, key_b, cosine of the mean vectors of both keys' values."""
    dims = cells.select("key", "value").distinct().join(vectors, "value").select("key", F.posexplode("vector").alias("i", "x"))
    mean = dims.groupBy("key", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("v"))
    j = pairs.join(mean.select(F.col("key").alias("key_a"), F.col("v").alias("va")), "key_a").join(mean.select(F.col("key").alias("key_b"), F.col("v").alias("vb")), "key_b")
    return j.select("key_a", "key_b", cosine("va", "vb").alias("cosine"))


def mixture(a: float, b: float, prior: float = 0.5) -> float:
    """Two codes' Bayesian mixture, of plain numbers."""
    low, high = sorted((a - math.log2(prior), b - math.log2(1 - prior)))
    return low - math.log2(1 + 2 ** (low - high))


