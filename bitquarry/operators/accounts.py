"""Evidence accounts on tables: what a (key, value) pair's records would save as a node of their own.

An account is named by its seed pair; its members are the records that hold
the pair with an owner in the background. For each key, the ledger compares
the members' cells under the background's code with a code of their own. The
ledger is priced in bulk from counts, all accounts in one job; pairs that stand
in one record only are left out beforehand, for one member can never pay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B


def ledger(cells: DataFrame, members: DataFrame | None = None, least: int = 2, n: int | None = None) -> DataFrame:
    """seed_key, seed_value, t, key, p, g: bits that each key saves the account (may be negative).

    members: the cells that are free to join (default: all); statistics of the
    background always come from all cells.
    """
    free = members if members is not None else cells
    total = cells.agg(F.count_distinct("rec_id").alias("n"))
    if n is not None:
        total = total.select(F.lit(n).cast("long").alias("n"))
    kv = cells.groupBy("key", "value").agg(F.count("*").alias("bc"))
    k = kv.groupBy("key").agg(F.sum("bc").alias("bp"), F.count("*").alias("bu"))
    often = free.groupBy("key", "value").agg(F.count("*").alias("t")).filter(F.col("t") >= least)
    seeds = free.join(often, ["key", "value"]).select(F.col("key").alias("seed_key"), F.col("value").alias("seed_value"), "t", "rec_id")
    joint = seeds.join(free.select("rec_id", "key", "value"), "rec_id").groupBy("seed_key", "seed_value", "t", "key", "value").agg(F.count("*").alias("c"))
    priced = joint.join(kv, ["key", "value"]).join(k, "key")
    per = priced.groupBy("seed_key", "seed_value", "t", "key").agg(
        F.sum("c").alias("p"), F.count("*").alias("u"), F.max("bp").alias("bp"), F.max("bu").alias("bu"),
        F.sum(F.col("c") * B.kt("bc", "bp", "bu")).alias("bg"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("less"))
    per = per.crossJoin(F.broadcast(total))  # one row
    absent = F.col("t") - F.col("p")
    presence = F.col("p") * B.kt("bp", "n", 2) + absent * B.kt(F.col("n") - F.col("bp"), F.col("n"), 2)
    own = B.vblock_bits(F.col("less"), F.col("p"), F.col("u"), B.naming_charge("bu")) + B.column_bits("p", "t")
    return per.select("seed_key", "seed_value", "t", "key", "p", (F.col("bg") + presence - own).alias("g"))


def releases(ledger_: DataFrame, n: int, keys: int, nodes: int = 0, edits: int = 0) -> DataFrame:
    """seed_key, seed_value, t, size, released, price, margin, support: each account's best prefix of its positive keys.

    Keys go by bits, then by name; every prefix is priced as a support.
    """
    w = Window.partitionBy("seed_key", "seed_value").orderBy(F.desc("g"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = ledger_.filter("g > 0").withColumn("size", F.row_number().over(Window.partitionBy("seed_key", "seed_value").orderBy(F.desc("g"), "key"))).withColumn("released", F.sum("g").over(w))
    price = B.node_price("t", "size", F.lit(float(n)), F.lit(float(nodes)), F.lit(float(edits)), F.lit(float(keys)))
    priced = pos.withColumn("price", price).withColumn("margin", F.col("released") - F.col("price"))
    best = priced.groupBy("seed_key", "seed_value", "t").agg(F.max_by(F.struct("size", "released", "price", "margin"), F.struct("margin", -F.col("size"))).alias("b"), F.array_sort(F.collect_list(F.struct((-F.col("g")).alias("m"), "key"))).alias("ks"))
    return best.select("seed_key", "seed_value", "t", "b.*", F.transform(F.slice("ks", 1, F.col("b.size")), lambda x: x.key).alias("support"))


def absence_credit(cells: DataFrame, least: int = 2) -> DataFrame:
    """seed_key, seed_value, t, absent_keys, credit: what an account of t records saves on the keys that none of them has.

    That is every key of the stream but those of its ledger. What the background
    spends on a key's absence is added up over all keys once and taken back for
    the ledger's, so no account meets the whole universe of keys.
    """
    total = cells.agg(F.count_distinct("rec_id").alias("n"))
    spent = cells.groupBy("key").agg(F.count("*").alias("bp")).crossJoin(F.broadcast(total)).select("key", B.kt(F.col("n") - F.col("bp"), F.col("n"), 2).alias("f"))  # one row
    every = spent.agg(F.sum("f").alias("all_f"), F.count("*").alias("all_keys"))
    often = cells.groupBy("key", "value").agg(F.count("*").alias("t")).filter(F.col("t") >= least)
    seeds = cells.join(often, ["key", "value"]).select(F.col("key").alias("seed_key"), F.col("value").alias("seed_value"), "t", "rec_id")
    has = seeds.join(cells.select("rec_id", "key"), "rec_id").groupBy("seed_key", "seed_value", "t", "key").agg(F.lit(1).alias("one")).join(spent, "key")
    own = has.groupBy("seed_key", "seed_value", "t").agg(F.sum("f").alias("own_f"), F.count("*").alias("own_keys")).crossJoin(F.broadcast(every))  # one row
    absent = F.col("all_keys") - F.col("own_keys")
    return own.select("seed_key", "seed_value", "t", absent.alias("absent_keys"), (F.col("t") * (F.col("all_f") - F.col("own_f")) - absent * B.column_bits(F.lit(0), "t")).alias("credit"))
