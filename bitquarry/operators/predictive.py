"""What each record costs when it arrives, under a mixture of the groups it might belong to.

Before a record is seen, every node with a member so far, and the background
with all records so far, has its say: for each key known so far whether the
record has it, and for a key it has the value, with a part of the probability
kept for a value never seen (an escape, after which the value is spelled).
Nodes weigh what members they have, plus a half. Keys never seen are spelled.

Every count is a segmented prefix sum of what came before the record, so the
stream is not walked through. The mixture itself has a row for each record and
node: that is what it sums over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.operators.prequential import CHUNK, prior_counts, prior_sum

#: The name of the background among the nodes.
BACKGROUND = ""


def escape_probability(total: Column, alphabet: Column) -> Column:
    """The share kept for a value never seen, beside (count + 1/2) / (total + (alphabet + 1) / 2) for each of the known ones."""
    return 0.5 / (total + (alphabet + 1) / 2)


def _absences(members: DataFrame, cells: DataFrame, chunk: int) -> DataFrame:
    """expert, t, bits, keys: of the state after t members, the bits of a record without any of the members' keys, and how many keys these are.

    One row for each member and key that its node has had by then is summed up.
    """
    at = prior_sum(members, ["expert"], F.lit(1), "before", chunk=chunk).select("expert", "rec_id", (F.col("before") + 1).alias("t"))
    first = at.join(cells, "rec_id").groupBy("expert", "key").agg(F.min("t").alias("from_t"))
    rows = at.join(first, "expert").filter("t >= from_t").join(cells.select("rec_id", "key", F.lit(1).alias("has")), ["rec_id", "key"], "left").fillna(0, ["has"])
    n = prior_sum(rows, ["expert", "key"], F.col("has"), "n", order="t", chunk=chunk).withColumn("n", F.col("n") + F.col("has"))
    return n.groupBy("expert", "t").agg(F.sum(F.log2(F.col("t") + 1.0) - F.log2(F.col("t") + 0.5 - F.col("n"))).alias("absent"), F.count("*").alias("keys"))


def expert_losses(cells: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_id, expert, weight, bits: what each node with a member before the record, and the background, spends on its known keys."""
    records = cells.select("rec_id").distinct()
    m = members.select(F.col("node").cast("string").alias("expert"), "rec_id").unionByName(records.select(F.lit(BACKGROUND).alias("expert"), "rec_id"))
    since = m.groupBy("expert").agg(F.min("rec_id").alias("since"))
    # a record meets each node that has a member before it (its own membership counts for later ones)
    grid = records.join(since, (F.col("rec_id") >= F.col("since")) | (F.col("expert") == BACKGROUND)).drop("since").join(m.withColumn("joins", F.lit(1)), ["expert", "rec_id"], "left").fillna(0, ["joins"])
    grid = prior_sum(grid, ["expert"], F.col("joins"), "t", chunk=chunk)
    met = grid.join(cells, "rec_id")
    met = prior_sum(prior_sum(met, ["expert", "key"], F.col("joins"), "n", chunk=chunk), ["expert", "key", "value"], F.col("joins"), "c", chunk=chunk)
    known = prior_counts(cells, chunk).select("rec_id", "key", (F.col("c") > 0).alias("seen"), F.col("n").alias("known"), F.col("u").alias("alphabet")).filter("known > 0")
    share = (F.col("n") + 0.5) / (F.col("t") + 1.0)
    value = F.when(F.col("seen"), -F.log2((F.col("c") + 0.5) / (F.col("n") + (F.col("alphabet") + 1) / 2))).otherwise(-F.log2(escape_probability(F.col("n"), F.col("alphabet"))) + B.string_bits("value"))
    present = met.join(known, ["rec_id", "key"]).groupBy("expert", "rec_id").agg(F.sum(F.log2(1 - share) - F.log2(share) + value).alias("present"))
    j = grid.filter((F.col("t") > 0) | (F.col("expert") == BACKGROUND)).join(present, ["expert", "rec_id"], "left").join(_absences(m, cells, chunk), ["expert", "t"], "left").join(known_keys(cells, chunk), "rec_id").fillna(0.0, ["present", "absent"]).fillna(0, ["keys"])
    unseen = -F.log2(1 - 0.5 / (F.col("t") + 1.0))
    return j.select("rec_id", "expert", (F.col("t") + 0.5).alias("weight"), (F.col("absent") + (F.col("known") - F.col("keys")) * unseen + F.col("present")).alias("bits"))


def known_keys(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_id, known: how many keys records before it have had."""
    born = cells.groupBy("key").agg(F.min("rec_id").alias("rec_id")).groupBy("rec_id").agg(F.count("*").alias("born"))
    records = cells.select("rec_id").distinct().join(born, "rec_id", "left").fillna(0, ["born"]).withColumn("one", F.lit(0))
    return prior_sum(records, ["one"], F.col("born"), "known", chunk=chunk).select("rec_id", "known")


def spelled(cells: DataFrame) -> DataFrame:
    """rec_id, spelled: bits of the keys that the record brings in, with their values, and of their number."""
    born = cells.groupBy("key").agg(F.min_by(F.struct("rec_id", "value"), "rec_id").alias("b")).select("key", "b.rec_id", "b.value")
    new = born.groupBy("rec_id").agg(F.count("*").alias("k"), F.sum(B.string_bits("key") + B.string_bits("value")).alias("s"))
    return cells.select("rec_id").distinct().join(new, "rec_id", "left").select("rec_id", (B.elias_gamma(F.coalesce("k", F.lit(0))) + F.coalesce("s", F.lit(0.0))).alias("spelled"))


def causal_losses(cells: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_id, bits: each record's cost under the mixture of nodes (members: node, rec_id) and background before it."""
    e = expert_losses(cells, members, chunk).withColumn("least", F.min("bits").over(Window.partitionBy("rec_id")))
    mixed = e.groupBy("rec_id").agg(F.min("least").alias("least"), (F.sum(F.col("weight") * F.pow(F.lit(2.0), F.col("least") - F.col("bits"))) / F.sum("weight")).alias("mean"))
    return mixed.join(spelled(cells), "rec_id").select("rec_id", (F.col("spelled") + F.col("least") - F.log2("mean")).alias("bits"))
