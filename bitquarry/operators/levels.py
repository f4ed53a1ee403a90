"""A partition coded flat, or as parents with leaves under them: whether a level pays for itself.

Leaves (parent, leaf, rec_id) part the records: a record is in one leaf. Nested,
a key is written once by the parent or by each leaf that has it, whichever is
shorter, key by key; a leaf points to its parent and tells its members among
the parent's. All of it is made of one table of counts by leaf, key and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.sources.scratch import saved


def counts(cells: DataFrame, leaves: DataFrame) -> DataFrame:
    """parent, leaf, key, value, c."""
    return leaves.join(cells, "rec_id").groupBy("parent", "leaf", "key", "value").agg(F.count("*").alias("c"))


def blocks(held: DataFrame, by: list[str], sizes: DataFrame, inventory: DataFrame) -> DataFrame:
    """by..., key, presence, values: bits of each key in each group; held: by..., key, value, c; sizes: by..., t."""
    g = held.groupBy(*by, "key").agg(F.sum("c").alias("p"), F.count("*").alias("u"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("s"))
    j = g.join(sizes, by).join(inventory, "key")
    return j.select(*by, "key", B.column_bits("p", "t").alias("presence"), B.vblock_bits(F.col("s"), F.col("p"), F.col("u"), B.naming_charge("inv")).alias("values"))


def _shape(k: Column) -> Column:
    return B.universal_int(k + 1) - F.when(k > 1, B.lg2(k + 1.0)).otherwise(0.0)


def _total(df: DataFrame, **terms: Column) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(name) for name, x in terms.items()])


def _group_terms(sizes: DataFrame, within: Column, kept: DataFrame, by: list[str], keys: DataFrame, prefix: str) -> DataFrame:
    """One row: structure, membership, support, presence and values of groups (sizes: by..., t and what ``within`` reads) with their keys (kept: by..., key, presence, values)."""
    of = kept.groupBy(*by).agg(F.count("*").alias("size"), F.sum("presence").alias("presence"), F.sum("values").alias("values"))
    j = sizes.join(of, by, "left").fillna(0, ["size"]).fillna(0.0, ["presence", "values"]).crossJoin(F.broadcast(keys))  # one row
    rows = j.agg(F.count("*").alias("k"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(name) for name, x in {"membership": B.column_bits("t", within), "support": B.support_bits_or_none("size", "a"), "presence": F.col("presence"), "values": F.col("values")}.items()])
    return rows.select(_shape(F.col("k")).alias(f"{prefix}structure"), *[F.col(x).alias(prefix + x) for x in ("membership", "support", "presence", "values")])


def placements(held: DataFrame, sizes: DataFrame, inventory: DataFrame) -> DataFrame:
    """parent, key, at_parent, at_leaves, kept: what a key costs written by the parent and by its leaves, and whether the parent keeps it (ties: it does)."""
    tops = sizes.groupBy("parent").agg(F.sum("t").alias("t"))
    whole = held.groupBy("parent", "key", "value").agg(F.sum("c").alias("c"))
    above = blocks(whole, ["parent"], tops, inventory).select("parent", "key", (F.col("presence") + F.col("values")).alias("at_parent"))
    below = blocks(held, ["parent", "leaf"], sizes, inventory).groupBy("parent", "key").agg(F.sum(F.col("presence") + F.col("values")).alias("at_leaves"))
    return above.join(below, ["parent", "key"]).withColumn("kept", F.round("at_parent", 9) <= F.round("at_leaves", 9))


def _world(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    per = cells.groupBy("key").agg(F.count_distinct("value").alias("inv"))
    one = per.agg(F.count("*").alias("a")).crossJoin(cells.agg(F.count_distinct("rec_id").alias("n")))  # one row each
    return per, one


def flat_and_nested(cells: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: terms of the leaves as groups of the whole stream (flat_...), and of parents (parent_...) with leaves (leaf_..., pointer); flat, nested: their totals."""
    inventory, one = _world(cells)
    inventory, one = saved(inventory), saved(one)
    held = saved(counts(cells, leaves))
    sizes = saved(leaves.groupBy("parent", "leaf").agg(F.count("*").alias("t")))
    tops = sizes.groupBy("parent").agg(F.sum("t").alias("t"))
    low = saved(blocks(held, ["parent", "leaf"], sizes, inventory))
    place = saved(placements(held, sizes, inventory))
    kept = place.filter("kept").select("parent", "key")
    high = blocks(held.groupBy("parent", "key", "value").agg(F.sum("c").alias("c")), ["parent"], tops, inventory).join(kept, ["parent", "key"], "left_semi")
    flat = _group_terms(sizes, F.col("n"), low, ["parent", "leaf"], one, "flat_")
    parents = _group_terms(tops, F.col("n"), high, ["parent"], one, "parent_")
    inside = sizes.join(tops.withColumnRenamed("t", "within"), "parent")
    under = _group_terms(inside, F.col("within"), low.join(kept, ["parent", "key"], "left_anti"), ["parent", "leaf"], one, "leaf_")
    pointer = sizes.agg((F.count("*") * F.log2(F.greatest(F.count_distinct("parent"), F.lit(1)))).alias("pointer"))
    row = flat.crossJoin(parents).crossJoin(under).crossJoin(pointer)  # one row each
    add = lambda start: sum((F.col(c) for c in row.columns if c.startswith(start)), F.lit(0.0))
    return row.withColumns({"flat": add("flat_"), "nested": add("parent_") + add("leaf_") + F.col("pointer")})


# nesting found in a cover


def purities(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, size, label, purity: the commonest label (rec_id, label) of a node's labelled members, of equals the first, and its share of all members."""
    size = members.groupBy("node").agg(F.count("*").alias("size"))
    seen = members.join(labels.filter("label IS NOT NULL"), "rec_id").groupBy("node", "label").agg(F.count("*").alias("c"))
    top = seen.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("x"))
    return size.join(top, "node", "left").select("node", "size", F.col("x.label").alias("label"), F.coalesce(-F.col("x.c") / F.col("size"), F.lit(0.0)).alias("purity"))


def nested_edges(members: DataFrame, support: DataFrame, families: DataFrame, species: DataFrame, inside: float = 0.8, pure: float = 0.8, mixed: float = 0.6) -> DataFrame:
    """child, parent, containment, child_label, parent_label: species nodes that lie in family nodes, with no key in common.

    A family node is pure by family and mixed by species, a species node is
    pure by species. Only pairs of nodes that share a record are met.
    """
    f, s = purities(members, families), purities(members, species)
    both = f.select("node", F.col("label").alias("family"), F.col("purity").alias("fp")).join(s.select("node", "size", F.col("label").alias("kind"), F.col("purity").alias("sp")), "node")
    parents = saved(both.filter((F.col("fp") >= pure) & (F.col("sp") < mixed)).select(F.col("node").alias("parent"), F.col("family").alias("parent_label")))
    children = saved(both.filter(F.col("sp") >= pure).select(F.col("node").alias("child"), F.col("kind").alias("child_label"), "size"))
    of = lambda side, df, what: df.withColumnRenamed("node", side).join(what.select(side), side, "left_semi")
    shared = of("child", members, children).join(of("parent", members, parents), "rec_id").groupBy("child", "parent").agg(F.count("*").alias("c"))
    common = of("child", support, children).join(of("parent", support, parents), "key").select("child", "parent").distinct()
    j = shared.filter("child <> parent").join(common, ["child", "parent"], "left_anti").join(children, "child").join(parents, "parent")
    return j.withColumn("containment", F.col("c") / F.col("size")).filter(F.col("containment") >= inside).select("child", "parent", "containment", "child_label", "parent_label")


def edge_scores(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: found, correct, planted, precision, recall of edges by their labels; gold: child_label, parent_label."""
    truth = gold.select("child_label", "parent_label").distinct()
    found = edges.join(truth.withColumn("right", F.lit(1)), ["child_label", "parent_label"], "left").agg(F.count("*").alias("found"), F.count("right").alias("correct"))
    row = found.crossJoin(truth.agg(F.count("*").alias("planted")))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return row.select("found", "correct", "planted", share("correct", "found").alias("precision"), share("correct", "planted").alias("recall"))


def inlining(support: DataFrame, key_levels: DataFrame) -> DataFrame:
    """node, upper, lower, inlined: a node's keys of either level (key, upper), and whether it writes its parent's keys beside its own."""
    g = support.join(key_levels, "key").groupBy("node").agg(F.count_if("upper").alias("upper"), F.count_if(~F.col("upper")).alias("lower"))
    return g.withColumn("inlined", (F.col("upper") > 0) & (F.col("lower") > 0))
