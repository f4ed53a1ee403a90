"""Evidence along a stream, detection times and small reports about streams, features and runs.

Running sums follow ``prequential``: a window runs inside a chunk of rec_ids
only, and one row for each group and chunk carries the sums over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.functions import text as T
from bitquarry.operators.prequential import CHUNK, prior_counts


def running_sup(df: DataFrame, groups: list[str], gain: Column, order: str = "rec_id", chunk: int = CHUNK) -> DataFrame:
    """groups, final, sup: the sum of ``gain`` along ``order``, and the greatest it ever was (0 at the start)."""
    at = df.withColumn("__chunk", F.floor(F.col(order) / chunk)).withColumn("__x", gain)
    inside = Window.partitionBy(*groups, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = at.withColumn("__g", F.sum("__x").over(inside)).groupBy(*groups, "__chunk").agg(F.sum("__x").alias("__s"), F.max("__g").alias("__top"))
    earlier = Window.partitionBy(*groups).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = per.withColumn("__base", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)))
    return based.groupBy(*groups).agg(F.sum("__s").alias("final"), F.greatest(F.lit(0.0), F.max(F.col("__base") + F.col("__top"))).alias("sup"))


def evidence_against_uniform(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, final, sup: bits by which an adaptive code beats the uniform one; by Ville's inequality sup passes b with probability 2 ** -b at most if values are uniform."""
    size = cells.groupBy("key").agg(F.count_distinct("value").alias("size"))
    return running_sup(prior_counts(cells, chunk).join(size, "key"), ["key"], F.log2("size") - B.kt("c", "n", "size"), chunk=chunk)


def harmonic(n: str | Column) -> Column:
    """1 + 1/2 + ... + 1/n for n >= 0: summed below 32, Euler and Maclaurin's series beyond."""
    n = F.col(n) if isinstance(n, str) else n
    k = F.least(n, F.lit(32)).cast("int")
    steps = F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    short = F.aggregate(steps, F.lit(0.0), lambda a, x: a + 1.0 / x)
    x = n.cast("double")
    series = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0)))
    return F.when(n <= 32, short).otherwise(series)


def first_mint(prices: DataFrame) -> DataFrame:
    """One row: the first record whose gain passes its price (null if none), from new_value_price."""
    return prices.filter("margin > 0").agg(F.min("rec_id").alias("first_mint"))


def detection_times(rates: DataFrame, t_max: int = 5000) -> DataFrame:
    """rates (rate, size, values, keys) with t: the least number of members, of 2 to ``t_max`` - 1, whose evidence pays a node's price; null if none.

    The t-th member is expected at record 2 * values * t.
    """
    t = F.col("t")
    n = F.greatest(t + 1, F.floor(t / (0.5 / F.col("values"))))
    price = B.node_price(t, "size", n, F.lit(0.0), F.lit(0.0), F.greatest(F.col("keys"), 2 * F.col("size")))
    tried = rates.distinct().withColumn("t", F.explode(F.sequence(F.lit(2), F.lit(t_max - 1))))
    return tried.groupBy("rate", "size", "values", "keys").agg(F.min(F.when(t * F.col("rate") >= price, t)).alias("t"))


def value_probabilities(counts: DataFrame) -> DataFrame:
    """counts (key, value, c) with probability, and escape (what any new value gets)."""
    total = counts.groupBy("key").agg((F.sum("c") + (F.count("*") + 1) / 2).alias("__d"))
    return counts.join(total, "key").select("key", "value", ((F.col("c") + 0.5) / F.col("__d")).alias("probability"), (0.5 / F.col("__d")).alias("escape"))


def field_bits(df: DataFrame, column: str, tokens=T.tokens) -> DataFrame:
    """One row: distinct_tokens, bits of a text column cut into tokens (null or tokenless: one empty token)."""
    ts = tokens(F.coalesce(F.col(column), F.lit("")))
    cut = df.select(F.when(F.size(ts) > 0, ts).otherwise(F.array(F.lit(""))).alias("ts"))
    lengths = cut.agg(F.sum(B.universal_int(F.size("ts") + 1)).alias("lengths"))
    c = cut.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    g = c.agg(F.sum("c").alias("n"), F.count("*").alias("u"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("s"))
    both = g.crossJoin(lengths)  # one-row tables
    return both.select(F.col("u").alias("distinct_tokens"), (F.col("lengths") + B.vblock_bits(F.col("s"), F.col("n"), F.col("u"), F.log2(F.col("u") + 1))).alias("bits"))


def stream_stats(cells: DataFrame, truth: DataFrame, enough: int) -> DataFrame:
    """One row: distinct pairs, how many (and which share) come ``enough`` times, the share seen once; kinds, those with such a pair, least and median best pair of a kind."""
    occ = cells.groupBy("key", "value").agg(F.count("*").alias("c"))
    pairs = occ.agg(F.count("*").alias("pairs"), F.count_if(F.col("c") >= enough).alias("pairs_enough"), F.avg((F.col("c") >= enough).cast("double")).alias("share_enough"), F.avg((F.col("c") == 1).cast("double")).alias("share_once"))
    best = cells.join(truth.select("rec_id", "truth"), "rec_id").groupBy("truth", "key", "value").agg(F.count("*").alias("c")).groupBy("truth").agg(F.max("c").alias("best"))
    kinds = best.agg(F.min("best").alias("cohort_min"), F.percentile("best", 0.5).alias("cohort_median"), F.count_if(F.col("best") >= enough).alias("kinds_reachable"), F.count("*").alias("kinds"))
    return pairs.crossJoin(kinds)  # one-row tables


def feature_resolution(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, share_zero, distinct_values, greatest, usable (more than 20 values, under 95 % zeros); nulls are left out."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*").filter("x IS NOT NULL")
    g = long.groupBy("feature").agg(F.avg((F.col("x") == 0).cast("double")).alias("share_zero"), F.count_distinct("x").alias("distinct_values"), F.max("x").alias("greatest"))
    return g.withColumn("usable", (F.col("distinct_values") > 20) & (F.col("share_zero") < 0.95))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation; 0 below three pairs and where a side doesn't vary."""
    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return r.select(F.when((F.col("n") < 3) | F.isnan("r"), 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("pearson"))


def spread(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, mean, least, greatest."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def pairwise_rand(runs: DataFrame) -> DataFrame:
    """run_a < run_b, ari: the adjusted Rand index of every two runs (run, rec_id, label), from counts of label pairs in one job."""
    a, b = runs.select(F.col("run").alias("run_a"), "rec_id", F.col("label").alias("la")), runs.select(F.col("run").alias("run_b"), "rec_id", F.col("label").alias("lb"))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    runs_ab = ["run_a", "run_b"]
    cells = a.join(b, "rec_id").filter("run_a < run_b").groupBy(*runs_ab, "la", "lb").agg(F.count("*").alias("n"))
    side = lambda c, out: cells.groupBy(*runs_ab, c).agg(F.sum("n").alias("n")).groupBy(*runs_ab).agg(F.sum(pairs("n")).alias(out))
    j = cells.groupBy(*runs_ab).agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("records")).join(side("la", "in_a"), runs_ab).join(side("lb", "in_b"), runs_ab)
    expected = F.col("in_a") * F.col("in_b") / pairs("records")
    most = (F.col("in_a") + F.col("in_b")) / 2
    return j.select(*runs_ab, F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def subsets(items: str | Column) -> Column:
    """All subsets of an array of at most 20 items, by their bits; raises beyond (2 ** n arrays are made in a row)."""
    items = F.col(items) if isinstance(items, str) else items
    n = F.size(items)
    masks = F.when(n <= 20, F.sequence(F.lit(0), F.pow(F.lit(2.0), n.cast("double")).cast("int") - 1)).otherwise(F.raise_error(F.lit("more than 20 items")).cast("array<int>"))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.floor(m / F.pow(F.lit(2.0), i.cast("double"))) % 2 == 1))
