"""The batch description length of a cover, and exact changes of it, on state tables.

State: cells (rec_id, key, value), membership (node, rec_id), support (node,
key), owner (node, rec_id, key): a cell's owner is a node or nobody (the
background). Everything is a grouped aggregate of these; a move is priced as
the difference of the terms it touches, for all candidate moves in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.functions import bits as B


@dataclass
class State:
    cells: DataFrame
    membership: DataFrame
    support: DataFrame
    owner: DataFrame


def from_partition(cells: DataFrame, labels: DataFrame, least_share: float = 0.0) -> State:
    """Each label (rec_id, label; null or -1 is background) is a node that supports and owns its members' keys.

    least_share: only keys that this share of the members has.
    """
    m = labels.filter("label IS NOT NULL AND CAST(label AS STRING) <> '-1'").select(F.col("label").cast("string").alias("node"), "rec_id")
    owned = cells.join(m, "rec_id").select("node", "rec_id", "key")
    sizes = m.groupBy("node").agg(F.count("*").alias("t"))
    support = owned.groupBy("node", "key").agg(F.count("*").alias("p")).join(sizes, "node").filter(F.col("p") >= least_share * F.col("t")).select("node", "key")
    return State(cells, m, support, owned.join(support, ["node", "key"], "left_semi"))


def node_terms(s: State) -> DataFrame:
    """node, t, structure (membership and support), presence, values: bits of each node's own."""
    n = s.cells.agg(F.count_distinct("rec_id").alias("n"), F.count_distinct("key").alias("keys"))
    t = s.membership.groupBy("node").agg(F.count("*").alias("t"))
    size = s.support.groupBy("node").agg(F.count("*").alias("size"))
    published = s.cells.join(s.membership, "rec_id").join(s.support, ["node", "key"]).groupBy("node", "key").agg(F.count("*").alias("p"))
    presence = s.support.join(published, ["node", "key"], "left").fillna(0, ["p"]).join(t, "node").groupBy("node").agg(F.sum(B.column_bits("p", "t")).alias("presence"))
    inv = inventory(s.cells)
    counts = s.cells.join(s.owner, ["rec_id", "key"]).groupBy("node", "key", "value").agg(F.count("*").alias("c"))
    values = _value_bits(counts, ["node", "key"], inv).groupBy("node").agg(F.sum("bits").alias("values"))
    j = t.join(size, "node").join(presence, "node").join(values, "node", "left").fillna(0.0, ["values"]).crossJoin(F.broadcast(n))  # one row
    return j.select("node", "t", (B.column_bits("t", "n") + B.support_bits("size", "keys")).alias("structure"), "presence", "values")


def inventory(cells: DataFrame) -> DataFrame:
    return cells.groupBy("key").agg(F.count_distinct("value").alias("inv"))


def _value_bits(counts: DataFrame, by: list[str], inv: DataFrame) -> DataFrame:
    g = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("u"), F.sum(B.kt_block_term(F.col("c") - 1)).alias("s"))
    return g.join(inv, "key").select(*by, "n", "u", B.vblock_bits(F.col("s"), F.col("n"), F.col("u"), B.naming_charge("inv")).alias("bits"))


def background_terms(s: State) -> DataFrame:
    """key, presence, values: the background's bits for each key, over the records that no supporting node covers."""
    n = s.cells.agg(F.count_distinct("rec_id").alias("n"))
    covered = s.support.join(s.membership, "node").groupBy("key").agg(F.count_distinct("rec_id").alias("covered"))
    pub = s.cells.select("rec_id", "key").join(s.support.join(s.membership, "node").select("rec_id", "key").distinct(), ["rec_id", "key"]).groupBy("key").agg(F.count("*").alias("pub"))
    keys = s.cells.groupBy("key").agg(F.count("*").alias("p"), F.count_distinct("value").alias("inv"))
    free = s.cells.join(s.owner, ["rec_id", "key"], "left_anti").groupBy("key", "value").agg(F.count("*").alias("c"))
    values = _value_bits(free, ["key"], keys.select("key", "inv")).select("key", F.col("bits").alias("values"))
    j = keys.join(covered, "key", "left").join(pub, "key", "left").join(values, "key", "left").fillna(0, ["covered", "pub"]).fillna(0.0, ["values"]).crossJoin(F.broadcast(n))  # one row
    n0 = F.col("n") - F.col("covered")
    p0 = F.greatest(F.lit(0), F.col("p") - F.col("pub"))
    return j.select("key", F.when(n0 > 0, B.column_bits(F.least(p0, n0), n0)).otherwise(0.0).alias("presence"), "values")


def total(s: State) -> DataFrame:
    """One row: nodes, structure, presence, values, total bits."""
    a = node_terms(s).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("structure"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("presence"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("values"), F.lit(0.0)).alias("v"))
    b = background_terms(s).agg(F.sum("presence").alias("bp"), F.sum("values").alias("bv"))
    k = F.col("nodes").cast("double")
    shape = B.universal_int(k + 1) - F.when(k > 1, B.lg2(k + 1)).otherwise(0.0)
    return a.crossJoin(b).select("nodes", (shape + F.col("s")).alias("structure"), (F.col("p") + F.col("bp")).alias("presence"), (F.col("v") + F.col("bv")).alias("values")).withColumn("total", F.col("structure") + F.col("presence") + F.col("values"))


def audit(s: State) -> DataFrame:
    """Violations: cells with two owners, owners that aren't members, owned keys without support."""
    twice = s.owner.groupBy("rec_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("two owners").alias("what"), "rec_id", "key")
    stranger = s.owner.join(s.membership, ["node", "rec_id"], "left_anti").select(F.lit("owner is no member").alias("what"), "rec_id", "key")
    unsupported = s.owner.join(s.support, ["node", "key"], "left_anti").select(F.lit("key without support").alias("what"), "rec_id", "key")
    return twice.unionByName(stranger).unionByName(unsupported)


def _shape_delta(nodes: int, change: int) -> float:
    import math

    def star(k: int) -> float:
        out, v = 0.0, float(k)
        while (v := math.log2(v)) > 0:
            out += v
        return out + B.LOG_STAR_CONSTANT

    at = lambda k: star(k + 1) - (math.lgamma(k + 1) / B.LN2 if k > 1 else 0.0)
    return at(nodes + change) - at(nodes)


def without(s: State, nodes: DataFrame) -> State:
    """The state without some nodes (column node); their cells go to the background."""
    cut = lambda df: df.join(nodes.select("node"), "node", "left_anti")
    return State(s.cells, cut(s.membership), cut(s.support), cut(s.owner))


def merged(s: State, into: DataFrame) -> State:
    """The state with nodes renamed by (node, target): members and supports are unions."""
    m = into.select("node", "target")
    move = lambda df: df.join(m, "node", "left").withColumn("node", F.coalesce("target", "node")).drop("target").distinct()
    return State(s.cells, move(s.membership).select("node", "rec_id"), move(s.support).select("node", "key"), move(s.owner).select("node", "rec_id", "key"))


def partition_merge_deltas(s: State) -> DataFrame:
    """a < b, delta for every pair of member-disjoint nodes that support a common key and own all their members' supported cells.

    Priced in closed form from counts: the background's terms change only by
    members that lack a key of the other's support, which the union covers too.
    """
    n = s.cells.agg(F.count_distinct("rec_id").alias("n"), F.count_distinct("key").alias("keys"))
    t = s.membership.groupBy("node").agg(F.count("*").alias("t"))
    size = s.support.groupBy("node").agg(F.count("*").alias("size"))
    own = node_terms(s).select("node", (F.col("structure") + F.col("presence") + F.col("values")).alias("bits"))
    k = s.membership.select("node").distinct().count()
    sup_a, sup_b = s.support.select(F.col("node").alias("a"), "key"), s.support.select(F.col("node").alias("b"), "key")
    common = sup_a.join(sup_b, "key").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    # values: blocks of both, added up
    counts = s.cells.join(s.owner, ["rec_id", "key"]).groupBy("node", "key", "value").agg(F.count("*").alias("c"))
    side = lambda x: common.select("a", "b").join(counts.withColumnRenamed("node", x), x).select("a", "b", "key", "value", "c")
    joint = side("a").unionByName(side("b")).groupBy("a", "b", "key", "value").agg(F.sum("c").alias("c"))
    values = _value_bits(joint, ["a", "b", "key"], inventory(s.cells)).groupBy("a", "b").agg(F.sum("bits").alias("values"), F.count("*").alias("u_keys"))
    published = joint.groupBy("a", "b", "key").agg(F.sum("c").alias("p"))
    sizes = common.join(t.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(size.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b")
    pres = published.join(sizes.select("a", "b", "ta", "tb"), ["a", "b"]).groupBy("a", "b").agg(F.sum(B.column_bits(F.col("p"), F.col("ta") + F.col("tb"))).alias("presence"))
    # background presence: keys in one support only now cover the other's members too
    one_sided = sup_a.join(common.select("a", "b"), "a").select("a", "b", "key", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(sup_b.join(common.select("a", "b"), "b").select("a", "b", "key", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))).groupBy("a", "b", "key").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).filter(F.col("in_a") + F.col("in_b") == 1)
    bg = _background_counts(s)
    wider = one_sided.join(sizes.select("a", "b", "ta", "tb"), ["a", "b"]).join(bg, "key")
    more = F.when(F.col("in_a") == 1, F.col("tb")).otherwise(F.col("ta"))
    cost = lambda n0: F.when(n0 > 0, B.column_bits(F.least(F.greatest(F.col("p0"), F.lit(0)), n0), n0)).otherwise(0.0)
    wide = wider.groupBy("a", "b").agg(F.sum(cost(F.col("n0") - more) - cost(F.col("n0"))).alias("wider"))
    rows = sizes.join(values, ["a", "b"]).join(pres, ["a", "b"]).join(wide, ["a", "b"], "left").fillna(0.0, ["wider"]).join(own.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a").join(own.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b").crossJoin(F.broadcast(n))
    support_size = F.col("sa") + F.col("sb") - F.col("common")
    after = B.column_bits(F.col("ta") + F.col("tb"), F.col("n")) + B.support_bits(support_size, F.col("keys")) + F.col("presence") + F.col("values")
    return rows.select("a", "b", (after - F.col("bits_a") - F.col("bits_b") + F.col("wider") + _shape_delta(k, -1)).alias("delta"))


def _background_counts(s: State) -> DataFrame:
    """key, n0 (records that no supporting node covers), p0 (of these, with the key)."""
    n = s.cells.agg(F.count_distinct("rec_id").alias("n"))
    cov = s.support.join(s.membership, "node").select("rec_id", "key").distinct()
    covered = cov.groupBy("key").agg(F.count("*").alias("covered"))
    free = s.cells.select("rec_id", "key").join(cov, ["rec_id", "key"], "left_anti").groupBy("key").agg(F.count("*").alias("p0"))
    keys = s.cells.select("key").distinct()
    return keys.join(covered, "key", "left").join(free, "key", "left").fillna(0, ["covered", "p0"]).crossJoin(F.broadcast(n)).select("key", (F.col("n") - F.col("covered")).alias("n0"), "p0")


def delete_deltas(s: State) -> DataFrame:
    """node, delta: each node's change of the total if it alone goes (its cells to the background), all in one job."""
    k = s.membership.select("node").distinct().count()
    own = node_terms(s).select("node", (F.col("structure") + F.col("presence") + F.col("values")).alias("bits"))
    bg = _background_counts(s)
    # records and cells that only this node covers, by key
    cov = s.support.join(s.membership, "node").select("node", "key", "rec_id")
    once = cov.groupBy("key", "rec_id").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1")
    back_n = once.groupBy("node", "key").agg(F.count("*").alias("dn"))
    back_p = once.join(s.cells.select("rec_id", "key"), ["rec_id", "key"]).groupBy("node", "key").agg(F.count("*").alias("dp"))
    pres = back_n.join(back_p, ["node", "key"], "left").fillna(0, ["dp"]).join(bg, "key")
    cost = lambda p, n: F.when(n > 0, B.column_bits(F.least(p, n), n)).otherwise(0.0)
    dpres = pres.groupBy("node").agg(F.sum(cost(F.col("p0") + F.col("dp"), F.col("n0") + F.col("dn")) - cost(F.col("p0"), F.col("n0"))).alias("dpres"))
    inv = inventory(s.cells)
    free = s.cells.join(s.owner, ["rec_id", "key"], "left_anti").groupBy("key", "value").agg(F.count("*").alias("c"))
    mine = s.cells.join(s.owner, ["rec_id", "key"]).groupBy("node", "key", "value").agg(F.count("*").alias("c"))
    touched = mine.select("node", "key").distinct()
    after = mine.unionByName(touched.join(free, "key").select("node", "key", "value", "c")).groupBy("node", "key", "value").agg(F.sum("c").alias("c"))
    before = _value_bits(free, ["key"], inv).select("key", F.col("bits").alias("before"))
    dval = _value_bits(after, ["node", "key"], inv).join(before, "key", "left").fillna(0.0, ["before"]).groupBy("node").agg(F.sum(F.col("bits") - F.col("before")).alias("dval"))
    j = own.join(dpres, "node", "left").join(dval, "node", "left").fillna(0.0, ["dpres", "dval"])
    return j.select("node", (F.col("dpres") + F.col("dval") - F.col("bits") + _shape_delta(k, -1)).alias("delta"))


def repair(s: State, most_rounds: int = 50, save=lambda df: df) -> State:
    """Deletes and merges while the total falls: each round takes a set of best moves that don't touch each other.

    save(df) is applied to the state tables after each round, to cut lineage.
    """
    for _ in range(most_rounds):
        moves = partition_merge_deltas(s).select("a", "b", "delta").unionByName(delete_deltas(s).select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "delta"))
        taken: set[str] = set()
        merges, deletes = [], []
        for r in moves.filter("delta < -1e-9").orderBy("delta", "a", "b").toLocalIterator():  # a row for each improving pair of nodes
            if r.a in taken or r.b in taken:
                continue
            taken |= {r.a, r.b} - {None}
            (merges if r.b is not None else deletes).append((r.a, r.b))
            break  # the terms of other keys' background change with each move, so one at a time is exact
        if not taken:
            return s
        spark = s.cells.sparkSession
        if deletes:
            s = without(s, spark.createDataFrame([(a,) for a, _ in deletes], "node string"))
        if merges:
            s = merged(s, spark.createDataFrame([(b, a) for a, b in merges], "node string, target string"))
        s = State(s.cells, save(s.membership), save(s.support), save(s.owner))
    return s
