"""Two states of a cover compared: which nodes answer to each other, and what changed.

Memberships are tables (node, rec_id). Overlaps are counted by a join on the
records; matching goes in rounds on the table of overlaps, each taking the
pairs that are the best of both their nodes. In a strict order that gives what
one walk down the sorted pairs would, without a walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.sources.scratch import drop, saved

#: The share of all records that makes a node big, and how alike its counterpart must be.
BIG = 0.05
ALIKE = 0.5


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, both, jaccard of every two nodes with a common record."""
    size = lambda df, name: df.groupBy("node").agg(F.count("*").alias(f"n_{name}")).withColumnRenamed("node", name)
    both = a.select(F.col("node").alias("a"), "rec_id").join(b.select(F.col("node").alias("b"), "rec_id"), "rec_id").groupBy("a", "b").agg(F.count("*").alias("both"))
    return both.join(size(a, "a"), "a").join(size(b, "b"), "b").select("a", "b", "both", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def match(pairs: DataFrame) -> DataFrame:
    """a, b, both, jaccard of the pairs that answer to each other: the largest overlap first, then by names, each node once."""
    left, taken = saved(pairs), None
    while not left.isEmpty():
        order = F.struct((-F.col("both")).alias("o"), "a", "b")
        best = lambda by: left.groupBy(by).agg(F.min(order).alias("x")).select("x.a", "x.b")  # noqa: B023, E731
        now = left.join(best("a"), ["a", "b"], "left_semi").join(best("b"), ["a", "b"], "left_semi")
        found = saved(now if taken is None else taken.unionByName(now))
        rest = saved(left.join(found.select("a"), "a", "left_anti").join(found.select("b"), "b", "left_anti"))
        drop(left, *([taken] if taken is not None else []))
        left, taken = rest, found
    return taken if taken is not None else left


def changed_records(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """rec_id of the records whose nodes in b do not answer to their nodes in a."""
    named = b.join(matched.select(F.col("b").alias("node"), "a"), "node", "left").select("rec_id", F.col("a").alias("node"), F.lit(1).alias("in_b"))
    j = a.select("rec_id", "node", F.lit(1).alias("in_a")).join(named, ["rec_id", "node"], "full")
    return j.filter("in_a IS NULL OR in_b IS NULL").select("rec_id").distinct()


def survival(pairs: DataFrame, members: DataFrame, side: str, records: int, share: float = BIG) -> DataFrame:
    """One row: big nodes of a side ("a" or "b"), how many have one alike on the other, and the least likeness of a best one."""
    least = max(2, round(share * records))
    big = members.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("node").alias(side))
    best = big.join(pairs.groupBy(side).agg(F.max("jaccard").alias("best")), side, "left").fillna(0.0, ["best"])
    return best.agg(F.count("*").alias(f"big_{side}"), F.count_if(F.col("best") >= ALIKE).alias(f"surviving_{side}"), F.min("best").alias(f"worst_{side}"))


def compare(a: DataFrame, b: DataFrame, records: int) -> DataFrame:
    """One row about two memberships over so many records: nodes, matched, likeness of the matched, changed records, survival of big nodes."""
    pairs = saved(overlaps(a, b))
    matched = match(pairs)
    nodes = lambda df, name: df.agg(F.count_distinct("node").alias(name))
    like = matched.agg(F.count("*").alias("matched"), F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"))
    changed = changed_records(a, b, matched).agg(F.count("*").alias("changed"))
    row = nodes(a, "nodes_a").crossJoin(nodes(b, "nodes_b")).crossJoin(like).crossJoin(changed).crossJoin(survival(pairs, a, "a", records)).crossJoin(survival(pairs, b, "b", records))  # one row each
    return row.withColumn("changed_share", F.col("changed") / records)
