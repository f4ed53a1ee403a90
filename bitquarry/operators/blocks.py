"""Codelengths of blocks: value counts of a key inside an owner (a node, a cluster, a table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.functions import bits as B


def value_blocks(cells: DataFrame, by: list[str] = ["key"]) -> DataFrame:
    """by..., value, c."""
    return cells.groupBy(*by, "value").agg(F.count("*").alias("c"))


def key_dictionary(cells: DataFrame) -> DataFrame:
    """key, published, inventory, first_seen."""
    per = cells.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("rec_id").alias("f"))
    return per.groupBy("key").agg(F.sum("n").alias("published"), F.count("*").alias("inventory"), F.min("f").alias("first_seen"))


def block_bits(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by..., total, distinct, kt_bits (alphabet: the block's values), vblock_bits (a name costs log2(distinct + 1))."""
    g = blocks.groupBy(*by).agg(
        F.sum("c").alias("total"), F.count("*").alias("distinct"),
        F.sum(B.kt_block_term("c")).alias("__kt"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("__less"))
    return g.select(*by, "total", "distinct", B.kt_block(F.col("__kt"), F.col("total"), F.col("distinct")).alias("kt_bits"), B.vblock_bits(F.col("__less"), F.col("total"), F.col("distinct"), B.naming_charge("distinct")).alias("vblock_bits"))


def entropy(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by..., entropy in bits of the block's shares: log2 N - sum(c log2 c) / N."""
    g = blocks.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return g.select(*by, (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def jensen_shannon(blocks: DataFrame, by: str, a: str, b: str, weight: float = 0.5) -> Column:
    """One row: the divergence between two owners' distributions over (key, value)."""
    one = lambda name, out: blocks.filter(F.col(by) == name).select("key", "value", (F.col("c") / F.sum("c").over(_all())).alias(out))
    return one(a, "p").join(one(b, "q"), ["key", "value"], "full").agg(F.sum(B.jensen_shannon_term("p", "q", weight)).alias("divergence"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def block_deltas(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Each block value's add_delta and remove_delta of vblock_bits (name cost of the block as it is)."""
    totals = blocks.groupBy(*by).agg(F.sum("c").alias("total"), F.count("*").alias("distinct"))
    j = blocks.join(totals, by)
    name = B.naming_charge("distinct")
    return j.select(*by, "value", "c", B.vblock_delta_add("c", "total", "distinct", name).alias("add_delta"), B.vblock_delta_remove("c", "total", "distinct", name).alias("remove_delta"))


def partition_bits(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """label, bits: KT code of every key's values and presence inside each label's records."""
    size = labels.groupBy("label").agg(F.count("*").alias("members"))
    with_label = cells.join(labels, "rec_id")
    blocks = value_blocks(with_label, ["label", "key"])
    per = block_bits(blocks, ["label", "key"]).join(size, "label")
    return per.groupBy("label").agg(F.sum(F.col("kt_bits") + B.column_bits("total", "members")).alias("bits"))
