"""What evidence does by chance: simulated streams as rows, and summaries of bounded size that merge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values that a summary's reservoir keeps for its quantiles.
RESERVOIR = 40_000


class _Blocks:
    """Value counts of many runs side by side."""

    def __init__(self, runs: int, values: int):
        self.c, self.n, self.u = np.zeros((runs, values)), np.zeros(runs), np.zeros(runs)
        self.rows, self.naming = np.arange(runs), np.log2(values + 1.0)

    def cost(self, x: np.ndarray) -> np.ndarray:
        """Bits of the next value: naming it in an empty block; else whether it is new, and which it is."""
        c = self.c[self.rows, x]
        with np.errstate(divide="ignore"):
            seen = -np.log2((self.n - self.u + 0.5) / (self.n + 1)) - np.log2((c + 0.5) / (self.n + self.u / 2))
        new = -np.log2((self.u + 0.5) / (self.n + 1)) + self.naming
        return np.where(self.n == 0, self.naming, np.where(c > 0, seen, new))

    def add(self, x: np.ndarray) -> None:
        self.u += self.c[self.rows, x] == 0
        self.c[self.rows, x] += 1
        self.n += 1


def null_sups(spark: SparkSession, runs: int, steps: int = 200, values: int = 10, warm: int = 200, seed: int = 0) -> DataFrame:
    """run, sup: the greatest evidence that a group of random records ever has against a background that has seen ``warm`` values.

    A run's draws depend on the run and the seed alone, however runs are dealt to tasks.
    """

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            draws = np.array([np.random.default_rng([seed, int(i)]).integers(0, values, warm + steps) for i in ids]).reshape(len(ids), warm + steps)
            background, own = _Blocks(len(ids), values), _Blocks(len(ids), values)
            evidence, sup = np.zeros(len(ids)), np.zeros(len(ids))
            for t in range(warm + steps):
                x = draws[:, t]
                if t >= warm:
                    evidence += background.cost(x) - own.cost(x)
                    own.add(x)
                    np.maximum(sup, evidence, out=sup)
                background.add(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sup)], names=["run", "sup"])

    return spark.range(runs).select(F.col("id").alias("run")).mapInArrow(simulate, "run bigint, sup double")


def exceedance(sups: DataFrame, levels: Sequence[float], offset: float = 0.0) -> DataFrame:
    """level, runs, share, error, bound: how often sup reaches level + offset, the standard error, and 2^-level."""
    reached = sups.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("level"), (F.col("sup") >= b + offset).cast("int").alias("over")) for b in levels])).alias("x")).select("x.*")
    g = reached.groupBy("level").agg(F.count("*").alias("runs"), F.avg("over").alias("share"))
    return g.select("level", "runs", "share", F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("runs")).alias("error"), F.pow(F.lit(2.0), -F.col("level")).alias("bound"))


def reservoir(df: DataFrame, by: list[str], name: str, value: str, size: int = RESERVOIR) -> DataFrame:
    """by..., value: of each group, the ``size`` rows with the smallest digests of their name; two reservoirs merge by taking these again."""
    digest = F.md5(F.col(name).cast("string").cast("binary"))
    rows = df.select(*by, name, value, digest.alias("__digest")).withColumn("__bin", F.substring("__digest", 1, 4))
    # of a large group, only digests up to the bin (of 65,536) in which it has ``size`` rows go on: no task sorts a whole group
    bins = rows.groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy("__bin")
    upto = bins.withColumn("__sum", F.sum("__n").over(order))
    last = upto.filter((F.col("__sum") >= size) & (F.col("__sum") - F.col("__n") < size))
    last = last.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__bin").alias("__last"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    few = rows.join(F.broadcast(last), same, "left").filter(F.col("__last").isNull() | (F.col("__bin") <= F.col("__last")))  # a row for each group of ``size`` rows or more
    order = Window.partitionBy(*by).orderBy("__digest", name)
    return few.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= size).select(*by, value)


def summaries(df: DataFrame, by: list[str], name: str, value: str, quantiles: dict[str, float], size: int = RESERVOIR) -> DataFrame:
    """by..., n, mean, least, greatest over all rows, and quantiles of the reservoir: the value at rank ceil(q n), 1 at least."""
    exact = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    kept = reservoir(df.filter(F.col(value).isNotNull()), by, name, value, size).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))  # ``size`` values at most
    at = lambda q: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size("v"))).cast("int"))
    return exact.join(kept, by).select(*by, "n", "mean", "least", "greatest", *[at(q).alias(c) for c, q in quantiles.items()])


def least_slack(sups: DataFrame, level: float) -> DataFrame:
    """One row, slack: the smallest offset (0 at least) at which no more than a share of 2^-level of the runs lies above level + offset: an order statistic."""
    ranked = sups.select("sup", F.row_number().over(Window.orderBy(F.desc("sup"))).alias("rank"))  # one row a run
    n = sups.count()
    may = int(n * 2.0**-level)
    return ranked.filter(F.col("rank") == may + 1).select(F.greatest(F.lit(0.0), F.col("sup") - level).alias("slack"))
