"""The branch code of a hierarchy: children told together, and predictors that all members train.

Nodes with the same parents are a family. Which of its children a record is in
is one pattern; the patterns that occur are listed and then coded by their
counts. A node's presence and values are predicted from all of its members
visited before, whoever owns their slots. Records are visited in turns: one of
each kind of membership, then the next of each. Turns and everything counted
along them are prefix sums, so no task walks the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.operators import ownership as O
from bitquarry.operators.prequential import CHUNK, prior_sum
from bitquarry.sources.scratch import drop, saved

#: The byte that names the code's options.
OPTION_BITS = 8


def visits(h: O.Owned, chunk: int = CHUNK) -> DataFrame:
    """rec_id, at (record too, if records stand as one): the order in which records are visited. Records with the same nodes take turns with the others'; at each turn the ones with later nodes come later."""
    records = h.cells.select("rec_id").distinct()
    nodes = saved(O.depths(h.links, h.members.select("node").distinct()))
    rank = nodes.select("node", (F.row_number().over(Window.orderBy("depth", "node")) - 1).alias("rank"))  # a row for each node
    k = nodes.count()
    kind = h.members.join(rank, "node").groupBy("rec_id").agg(F.array_sort(F.collect_list("rank")).alias("kind"))
    of = records.join(kind, "rec_id", "left").withColumn("kind", F.coalesce("kind", F.array().cast("array<int>")))
    # compared as rows of zeros and ones over the nodes in their order
    marks = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.array_contains("kind", i.cast("int")).cast("int").cast("string")))
    kinds = saved(of.select("kind").distinct().withColumn("marks", marks))
    order = kinds.select("kind", F.row_number().over(Window.orderBy("marks")).alias("place"))  # a row for each kind of membership
    placed = of.join(order, "kind").select("rec_id", "place")
    at = (F.col("turn") * kinds.count() + F.col("place")).alias("at")
    if h.records is None:
        return prior_sum(placed, ["place"], F.lit(1), "turn", chunk=chunk).select("rec_id", at)
    return prior_sum(h.records.join(placed, "rec_id"), ["place"], F.lit(1), "turn", order="record", chunk=chunk).select("record", "rec_id", at)


def family_patterns(h: O.Owned) -> DataFrame:
    """family, children, pattern (its nodes that hold a record), c: how many of the records that may be in a family are in just these of its children."""
    nodes = h.members.select("node").distinct()
    parents = nodes.join(h.links.select(F.col("child").alias("node"), "parent"), "node", "left").groupBy("node").agg(F.array_sort(F.collect_list("parent")).alias("parents")).withColumn("family", F.array_join("parents", "|"))
    family = saved(parents.groupBy("family", "parents").agg(F.count("*").alias("children")))
    inside = h.members.join(parents.select("node", "family"), "node").groupBy("family", "rec_id").agg(F.array_sort(F.collect_list("node")).alias("pattern"))
    below = family.filter(F.size("parents") > 0).select("family", F.explode("parents").alias("node"), F.size("parents").alias("k")).join(h.members, "node").groupBy("family", "rec_id", "k").agg(F.count("*").alias("n")).filter("n = k").select("family", "rec_id")
    tops = family.filter(F.size("parents") == 0).select("family")
    may = below.unionByName(h.cells.select("rec_id").distinct().join(tops).select("family", "rec_id"))  # tops is one row or none
    seen = O.weighed(h, may.join(inside, ["family", "rec_id"], "left")).withColumn("pattern", F.coalesce("pattern", F.array().cast("array<string>")))
    return seen.groupBy("family", "pattern").agg(F.sum("w").alias("c")).join(family.select("family", "children"), "family")


def predicted(h: O.Owned, order: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rec_id, node, key, presence, values: bits of every owned slot, predicted by its node's members visited before.

    What a slot holds and who owns it is looked up by what its record stands
    as. Slots are dealt once, by chunks of the order; a chunk begins with rows
    for what was counted before it.
    """
    d = h.cells.groupBy("key").agg(F.count_distinct("value").alias("d"))
    slots = h.members.join(h.support, "node").join(h.cells.select("rec_id", "key", "value"), ["rec_id", "key"], "left")
    slots = saved(slots.join(h.owners.select("rec_id", "key", "node", F.lit(True).alias("own")), ["rec_id", "key", "node"], "left").join(d, "key"))
    at = order.select(F.floor(F.col("at") / chunk).alias("chunk"), "at", "rec_id", F.col("rec_id" if h.records is None else "record").alias("record"))
    held = at.groupBy("chunk", "rec_id").agg(F.count("*").alias("m")).join(slots, "rec_id").groupBy("chunk", "node", "key", "value").agg(F.sum("m").alias("m"))
    held = saved(held.withColumn("ones", F.when(F.col("value").isNotNull(), F.col("m")).otherwise(0)))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda *by: Window.partitionBy("chunk", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    null, sum_ = F.lit(None), lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = lambda at_, value, t, n, c: ["chunk", F.lit(at_).cast("long").alias("at"), null.cast("long").alias("record"), "node", "key", value.cast("string").alias("value"), null.cast("boolean").alias("own"), null.cast("long").alias("d"), t.alias("t"), n.alias("n"), c.alias("c")]
    none = F.lit(0).cast("long")
    pairs = held.groupBy("chunk", "node", "key").agg(F.sum("m").alias("m"), F.sum("ones").alias("ones")).select(*before(-2, null, sum_("m", earlier("node", "key")), sum_("ones", earlier("node", "key")), none))
    values = held.filter("value IS NOT NULL").select(*before(-1, F.col("value"), none, none, sum_("m", earlier("node", "key", "value"))))
    one = F.col("value").isNotNull().cast("long")
    rows = at.join(slots, "rec_id").select("chunk", "at", "record", "node", "key", "value", "own", "d", F.lit(1).cast("long").alias("t"), one.alias("n"), one.alias("c"))
    j = rows.unionByName(pairs).unionByName(values).repartition("chunk")
    j = j.select("record", "node", "key", "own", "d", one.alias("has"), *(sum_(x, within("node", "key")).alias(x) for x in "tn"), sum_("c", within("node", "key", "value")).alias("c")).filter("own").withColumnRenamed("record", "rec_id")
    presence = -F.log2((F.when(F.col("has") == 1, F.col("n")).otherwise(F.col("t") - F.col("n")) + 0.5) / (F.col("t") + 1.0))
    values = F.when(F.col("has") == 1, -F.log2((F.col("c") + 0.5) / (F.col("n") + F.col("d") / 2))).otherwise(0.0)
    return j.select("rec_id", "node", "key", presence.alias("presence"), values.alias("values"))


def description(h: O.Owned, chunk: int = CHUNK) -> DataFrame:
    """One row: header, structure, membership_patterns, membership, ownership, presence, values, total. Header, structure and ownership are as in the plain code."""
    plain = saved(O.description(h))
    p = saved(family_patterns(h))
    listed = p.groupBy("family").agg(F.count("*").alias("k"), F.sum(B.binary_bits(F.size("pattern"), F.col("children"))).alias("bits"), F.sum("c").alias("n"), F.sum(B.kt_block_term("c")).alias("s"))
    patterns = listed.agg(F.coalesce(F.sum(B.elias_gamma("k") + F.col("bits")), F.lit(0.0)).alias("membership_patterns"), F.coalesce(F.sum(F.when(F.col("k") > 1, B.kt_block(F.col("s"), F.col("n"), F.col("k"))).otherwise(0.0)), F.lit(0.0)).alias("membership"))
    order = saved(visits(h, chunk))
    own = predicted(h, order, chunk).agg(F.coalesce(F.sum("presence"), F.lit(0.0)).alias("op"), F.coalesce(F.sum("values"), F.lit(0.0)).alias("ov"))
    # the background's slots cost what they cost in the plain code
    free = background(h)
    row = plain.select((F.col("header") + OPTION_BITS).alias("header"), "structure", "ownership").crossJoin(patterns).crossJoin(own).crossJoin(free)  # one row each
    out = saved(row.select("header", "structure", "membership_patterns", "membership", "ownership", (F.col("op") + F.col("bp")).alias("presence"), (F.col("ov") + F.col("bv")).alias("values")))
    drop(plain, p, order)
    return out.withColumn("total", sum((F.col(c) for c in out.columns), F.lit(0.0)))


def background(h: O.Owned) -> DataFrame:
    """One row: bp, bv, bits of presence and values of all slots without an owner, by the histograms of the header."""
    n = O.size(h)
    owned = O.weighed(h, h.owners.join(h.cells.select("rec_id", "key", "value"), ["rec_id", "key"], "left")).groupBy("key", "value").agg(F.sum("w").alias("taken"))
    hist = O.weighed(h, h.cells).groupBy("key", "value").agg(F.sum("w").alias("c")).join(owned.filter("value IS NOT NULL"), ["key", "value"], "left").fillna(0, ["taken"])
    keys = hist.groupBy("key").agg(F.sum("c").alias("p"), F.count("*").alias("d"), F.sum("taken").alias("taken"))
    absent = owned.filter("value IS NULL").select("key", F.col("taken").alias("gone"))
    share = (F.col("p") + 0.5) / (F.col("n") + 1)
    presence = keys.join(absent, "key", "left").fillna(0, ["gone"]).crossJoin(F.broadcast(n)).agg(F.coalesce(-F.sum((F.col("p") - F.col("taken")) * F.log2(share) + (F.col("n") - F.col("p") - F.col("gone")) * F.log2(1 - share)), F.lit(0.0)).alias("bp"))  # one row
    values = hist.join(keys.select("key", "p", "d"), "key").agg(F.coalesce(-F.sum((F.col("c") - F.col("taken")) * F.log2((F.col("c") + 0.5) / (F.col("p") + F.col("d") / 2))), F.lit(0.0)).alias("bv"))
    return presence.crossJoin(values)
