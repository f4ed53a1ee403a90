"""What each cell costs when it arrives, from statistics of the records before it.

Prior counts are segmented prefix sums: counts for each chunk of rec_ids are
added up over the earlier chunks (one row for each group and chunk), and a
window runs inside a chunk only, so a key that every record has is spread over
as many tasks as there are chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B

CHUNK = 65_536


def prior_sum(df: DataFrame, groups: list[str], value: Column, name: str, order: str = "rec_id", chunk: int = CHUNK) -> DataFrame:
    """df with the sum of value over earlier rows of the group (order must be unique in a group)."""
    at = df.withColumn("__chunk", F.floor(F.col(order) / chunk)).withColumn("__x", value.cast("long"))
    inside = Window.partitionBy(*groups, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = at.groupBy(*groups, "__chunk").agg(F.sum("__x").alias("__s")).withColumn("__base", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).drop("__s")
    local = at.withColumn("__in", F.coalesce(F.sum("__x").over(inside), F.lit(0)))
    return local.join(bases, [*groups, "__chunk"]).withColumn(name, F.col("__in") + F.col("__base")).drop("__chunk", "__x", "__in", "__base")


def prior_counts(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """cells with c (value seen), n (key seen) and u (the key's distinct values), all before the record."""
    seen = prior_sum(cells, ["key", "value"], F.lit(1), "c", chunk=chunk)
    counted = prior_sum(seen, ["key"], F.lit(1), "n", chunk=chunk)
    return prior_sum(counted, ["key"], (F.col("c") == 0).cast("int"), "u", chunk=chunk)


def background_bits(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """cells with value_bits of the background's code; a key's inventory is its distinct values so far."""
    p = prior_counts(cells, chunk)
    return p.withColumn("value_bits", B.block_cost("c", "n", "u", B.naming_charge("u")))


def presence_bits(cells: DataFrame, records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """cells with presence_bits: that the record has the key; past counts records before it."""
    order = prior_sum(records.select("rec_id", F.lit(0).alias("one")), ["one"], F.lit(1), "past", chunk=chunk).drop("one")
    seen = prior_sum(cells, ["key"], F.lit(1), "p", chunk=chunk).join(order, "rec_id")
    return seen.withColumn("presence_bits", B.kt("p", "past", 2))


def running_inventory(cells: DataFrame) -> DataFrame:
    """rec_id, key, inventory (distinct values up to and with the record) where it grows."""
    p = prior_counts(cells)
    return p.filter("c = 0").select("rec_id", "key", (F.col("u") + 1).alias("inventory"))


def rare_cells(cells: DataFrame, most: int = 1) -> DataFrame:
    """key, cells, rare_final (value's total at most ``most``) and rare_first (new when it arrived)."""
    totals = cells.groupBy("key", "value").agg(F.count("*").alias("total"))
    final = totals.groupBy("key").agg(F.sum("total").alias("cells"), F.sum(F.when(F.col("total") <= most, F.col("total")).otherwise(0)).alias("rare_final"), F.count("*").alias("rare_first"))
    return final


def new_value_price(cells: DataFrame, members: int = 1) -> DataFrame:
    """For each record, what an immediate node of its own would cost and bring: rec_id, price, gain, margin.

    The gain is what its cells cost in the background; the node's own code
    pays one naming for each value.
    """
    p = background_bits(cells)
    per = p.groupBy("rec_id").agg(F.count("*").alias("size"), F.sum("value_bits").alias("gain"), F.sum(B.naming_charge("u")).alias("own"))
    keys = cells.groupBy("key").agg(F.min("rec_id").alias("first"))
    born = keys.groupBy(F.col("first").alias("rec_id")).agg(F.count("*").alias("new"))
    with_new = per.join(born, "rec_id", "left").fillna(0, ["new"]).withColumn("one", F.lit(0))
    grown = prior_sum(prior_sum(with_new, ["one"], F.lit(1), "past"), ["one"], F.col("new"), "known").drop("one")
    n, keys_now = F.col("past") + 1, F.col("known") + F.col("new")
    price = B.node_price(F.lit(float(members)), F.col("size"), n, F.lit(0.0), F.lit(0.0), keys_now)
    return grown.select("rec_id", price.alias("price"), (F.col("gain") - F.col("own")).alias("gain")).withColumn("margin", F.col("gain") - F.col("price"))
