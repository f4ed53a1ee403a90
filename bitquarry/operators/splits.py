"""Splits of nodes and new nodes out of the residual, proposed and priced for all nodes in one job.

Members that look alike (same cells, owned alike) are one weighted *type* of
their node, so what follows works on types and not on members. A proposal is a
part: (node, part, type), the types that stay together; the rest of the node's
members is the other half. Parts come from pairs and keys that some members
have, grown by one assignment under each half's value counts (``grown``), and
from two-means runs over the types' cells, all runs of all nodes side by side
(``means``). ``deltas`` prices them exactly. The naming charge grows with how
many parts a node was offered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.operators import objective
from bitquarry.operators.objective import State
from bitquarry.sources.scratch import drop, saved

#: Pairs and keys that open a part, at most, the commonest first (the charge counts what was offered).
SEEDS = 64
RESTARTS = 4
BINARY_ROUNDS = 12
COSINE_ROUNDS = 10
COSINE = "cosine"


def member_types(cells: DataFrame, members: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """node, rec_id, type, held: each member's cells (key, value, owned), and a digest of them. Without owner all cells are owned."""
    c = members.select("node", "rec_id").join(cells.select("rec_id", "key", "value"), "rec_id")
    if owner is None:
        c = c.withColumn("owned", F.lit(True))
    else:
        c = c.join(owner.select("node", "rec_id", "key").withColumn("owned", F.lit(True)), ["node", "rec_id", "key"], "left").fillna(False, ["owned"])
    held = c.groupBy("node", "rec_id").agg(F.array_sort(F.collect_list(F.struct("key", "value", "owned"))).alias("held"))
    return held.withColumn("type", F.md5(F.to_json("held").cast("binary")))


def types(typed: DataFrame) -> DataFrame:
    """node, type, n, first, size, held: weighted types; first is their smallest rec_id."""
    return typed.groupBy("node", "type").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"), F.first("held").alias("held")).withColumn("size", F.size("held"))


def atoms(kinds: DataFrame) -> DataFrame:
    """node, type, n, key, value, owned."""
    return kinds.select("node", "type", "n", F.explode("held").alias("c")).select("node", "type", "n", "c.key", "c.value", "c.owned")


def seeds(a: DataFrame, sizes: DataFrame, least: int, most: int = SEEDS, keys: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parts by a pair or (keys) by a key alone, and offered: node, count. The rest has ``least`` members or more.

    sizes: node, t. A part by a key alone is offered as it is ("raw") and grown.
    """

    def ranked(by: list[str], name: Column) -> DataFrame:
        carriers = a.groupBy("node", *by).agg(F.sum("n").alias("c")).join(sizes, "node").filter((F.col("c") > 1) & (F.col("c") <= F.col("t") - least))
        order = Window.partitionBy("node").orderBy(F.desc("c"), *by)
        return carriers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("node", name.alias("part"), *by)

    pairs = saved(ranked(["key", "value"], F.concat_ws("=", "key", "value")))
    parts = a.join(pairs, ["node", "key", "value"]).select("node", "part", "type")
    offered = pairs.groupBy("node").agg(F.count("*").alias("offered"))
    if keys:
        named = saved(ranked(["key"], F.col("key")))
        parts = parts.unionByName(a.join(named, ["node", "key"]).select("node", "part", "type").distinct())
        offered = offered.unionByName(named.groupBy("node").agg((2 * F.count("*")).alias("offered"))).groupBy("node").agg(F.sum("offered").alias("offered"))
    return parts, offered


def grown(a: DataFrame, parts: DataFrame, inventory: DataFrame) -> DataFrame:
    """node, part, type: the types of a node that cost no more under the part's value counts than under the rest's.

    Every key is read, whether the node supports it or not. A pair's weight for
    a part is the difference of its costs; a type's weights are added up.
    """
    inside = parts.join(a, ["node", "type"])
    has = inside.groupBy("node", "part", "key", "value").agg(F.sum("n").alias("ca"))
    has_key = inside.groupBy("node", "part", "key").agg(F.sum("n").alias("na"))
    every = a.groupBy("node", "key", "value").agg(F.sum("n").alias("c"))
    every_key = every.groupBy("node", "key").agg(F.sum("c").alias("nc"))
    pairs = parts.select("node", "part").distinct().join(every, "node").join(every_key, ["node", "key"]).join(has, ["node", "part", "key", "value"], "left").join(has_key, ["node", "part", "key"], "left").fillna(0, ["ca", "na"]).join(inventory, "key")
    share = lambda c, n: (c + 0.5) / (n + 0.5 * F.col("inv"))
    weight = F.log2(share(F.col("ca"), F.col("na"))) - F.log2(share(F.col("c") - F.col("ca"), F.col("nc") - F.col("na")))
    scores = a.join(pairs.select("node", "part", "key", "value", weight.alias("w")), ["node", "key", "value"]).groupBy("node", "part", "type").agg(F.sum("w").alias("w"))
    return scores.filter(F.round("w", 9) >= 0).select("node", "part", "type")


# two-means


def _pick(kinds: DataFrame, score: Column) -> DataFrame:
    """The type of each node with the greatest score; of equal ones the one with the smallest first record."""
    best = kinds.groupBy("node").agg(F.max(F.struct(score.alias("s"), (-F.col("first")).alias("f"), F.col("type").alias("type"))).alias("b"))
    return best.select("node", F.col("b.s").alias("s"), F.col("b.type").alias("type"))


def _shared(a: DataFrame, w: DataFrame, by: list[str]) -> DataFrame:
    """node, type, by..., shared: summed weights of the cells that a type shares with w (node, by..., key, value, w)."""
    return a.select("node", "type", "key", "value").join(w, ["node", "key", "value"]).groupBy("node", "type", *by).agg(F.sum("w").alias("shared"))


def starts(kinds: DataFrame, a: DataFrame, restarts: int = RESTARTS) -> DataFrame:
    """node, run, side, type: furthest-point starts. Run i takes the picks 2i and 2i + 1; the run "cosine" the type least like all, and the one least like that."""
    cell = a.select("node", "type", "key", "value")
    one = lambda picked: picked.join(cell, ["node", "type"]).select("node", "key", "value", F.lit(1.0).alias("w"))
    now = kinds.select("node", "type", "first", "size", F.col("size").cast("double").alias("far"))
    picks, steps = [], []
    for i in range(2 * restarts):
        picked = saved(_pick(now, F.col("far")).filter("s > 0").select("node", "type"))
        picks.append(picked.withColumn("i", F.lit(i)))
        sized = picked.join(kinds.select("node", "type", F.col("size").alias("ps")), ["node", "type"]).select("node", "ps")
        apart = now.join(sized, "node").join(_shared(a, one(picked), []), ["node", "type"], "left").fillna(0.0, ["shared"])
        d = F.col("size") + F.col("ps") - 2 * F.col("shared")
        # the first pick is by size; from then on a type's distance is that to its nearest pick
        now = saved(apart.select("node", "type", "first", "size", (d if i == 0 else F.least("far", d)).alias("far")))
        steps.append(now)
    whole = a.groupBy("node", "key", "value").agg(F.sum("n").cast("double").alias("w"))
    like = lambda w: kinds.join(_shared(a, w, []), ["node", "type"], "left").fillna(0.0, ["shared"])
    away = -F.round(F.col("shared") / F.sqrt("size"), 9)
    far = saved(_pick(like(whole), away).select("node", "type"))
    farther = _pick(like(one(far)), away).select("node", "type")
    every = reduce(DataFrame.unionByName, picks)
    full = every.groupBy("node", F.floor(F.col("i") / 2).alias("r")).agg(F.count("*").alias("k")).filter("k = 2")
    binary = every.withColumn("r", F.floor(F.col("i") / 2)).join(full, ["node", "r"]).select("node", F.col("r").cast("string").alias("run"), (F.col("i") % 2).alias("side"), "type")
    cosine = far.withColumn("side", F.lit(0)).unionByName(farther.withColumn("side", F.lit(1))).select("node", F.lit(COSINE).alias("run"), "side", "type")
    out = saved(binary.unionByName(cosine))
    drop(*steps)
    return out


def means(kinds: DataFrame, a: DataFrame, restarts: int = RESTARTS) -> DataFrame:
    """node, part, type: two-means parts of every node with four members or more.

    Binary runs use Euclidean distance of cell sets and centroids rounded to
    the cells that half a side has; the cosine run uses mean profiles. One
    round assigns the types of all runs of all nodes at once. A binary run
    whose side is empty keeps its part of the round before; the cosine run then
    gives none.
    """
    enough = kinds.groupBy("node").agg(F.sum("n").alias("t")).filter("t >= 4").select("node")
    kinds = saved(kinds.join(enough, "node", "left_semi").select("node", "type", "n", "first", "size"))
    a = saved(a.join(enough, "node", "left_semi").select("node", "type", "n", "key", "value"))
    first = starts(kinds, a, restarts)
    centres = saved(first.join(a, ["node", "type"]).select("node", "run", "side", "key", "value", F.lit(1.0).alias("w")))
    before = None
    parts = []
    is_cosine = F.col("run") == COSINE
    for k in range(max(BINARY_ROUNDS, COSINE_ROUNDS)):
        norms = centres.groupBy("node", "run").agg(*[F.sum(F.when(F.col("side") == s, F.col("w") * F.col("w"))).alias(f"q{s}") for s in (0, 1)]).fillna(0.0)
        near = _shared(a, centres, ["run", "side"]).groupBy("node", "run", "type").agg(*[F.sum(F.when(F.col("side") == s, F.col("shared"))).alias(f"s{s}") for s in (0, 1)])
        j = kinds.join(norms, "node").join(near, ["node", "run", "type"], "left").fillna(0.0, ["s0", "s1"])
        part = lambda s, q: F.when(F.col(q) > 0, F.round(F.col(s) / F.sqrt(q), 12)).otherwise(0.0)
        inside = F.when(is_cosine, part("s0", "q0") >= part("s1", "q1")).otherwise(F.col("q0") - 2 * F.col("s0") <= F.col("q1") - 2 * F.col("s1"))
        after = saved(j.select("node", "run", "type", "n", inside.alias("a")))
        old = after.withColumn("was", F.lit(None).cast("boolean")) if before is None else after.join(before.select("node", "run", "type", F.col("a").alias("was")), ["node", "run", "type"], "left")
        state = saved(old.groupBy("node", "run").agg(F.max("a").alias("some"), F.min("a").alias("every"), F.min(F.col("a").eqNullSafe(F.col("was"))).alias("same"), F.max("was").isNotNull().alias("had")))
        whole = ~F.col("some") | F.col("every")
        last = is_cosine & F.lit(k + 1 >= COSINE_ROUNDS) | ~is_cosine & F.lit(k + 1 >= BINARY_ROUNDS)
        take = lambda runs, df: df.join(runs.select("node", "run"), ["node", "run"], "left_semi").filter("a").select("node", "run", "type")
        parts.append(saved(take(state.filter(~whole & (F.col("same") | last)), after)))
        if before is not None:
            parts.append(saved(take(state.filter(whole & ~is_cosine & F.col("had")), before)))
        going = state.filter(~whole & ~F.col("same") & ~last).select("node", "run")
        before = saved(after.join(going, ["node", "run"], "left_semi"))
        drop(centres, after)
        if before.isEmpty():
            break
        side = F.when(F.col("a"), 0).otherwise(1)
        held = before.withColumn("side", side)
        size = held.groupBy("node", "run", "side").agg(F.sum("n").alias("t"))
        counts = held.select("node", "run", "side", "type").join(a, ["node", "type"]).groupBy("node", "run", "side", "key", "value").agg(F.sum("n").alias("c")).join(size, ["node", "run", "side"])
        centres = saved(counts.filter(is_cosine | (F.col("c") * 2 >= F.col("t"))).select("node", "run", "side", "key", "value", F.when(is_cosine, F.col("c") / F.col("t")).otherwise(1.0).alias("w")))
    named = F.when(is_cosine, F.lit("two-means")).otherwise(F.concat(F.lit("binary "), F.col("run")))
    return reduce(DataFrame.unionByName, parts).select("node", named.alias("part"), "type")


# prices


def _bits(counts: Column) -> Column:
    return F.sum(F.when(counts > 0, B.kt_block_term(counts - 1)))


def deltas(s: State, kinds: DataFrame, a: DataFrame, parts: DataFrame) -> DataFrame:
    """node, part, size, delta: the change of the total if the part and the rest become nodes of their own.

    Both halves keep the node's support, so the background and its coverage
    stay. Parts that hold no member or all are left out.
    """
    world = s.cells.agg(F.count_distinct("rec_id").alias("n"), F.count_distinct("key").alias("keys"))
    t = s.membership.groupBy("node").agg(F.count("*").alias("t"))
    k = s.membership.select("node").distinct().count()
    size = parts.join(kinds.select("node", "type", "n"), ["node", "type"]).groupBy("node", "part").agg(F.sum("n").alias("ta")).join(t, "node").filter("ta < t")
    supported = a.join(s.support, ["node", "key"], "left_semi")
    inside = parts.join(supported, ["node", "type"])
    # presence, key by key
    p = supported.groupBy("node", "key").agg(F.sum("n").alias("p"))
    pa = inside.groupBy("node", "part", "key").agg(F.sum("n").alias("pa"))
    keys = size.join(s.support, "node").join(p, ["node", "key"], "left").join(pa, ["node", "part", "key"], "left").fillna(0, ["p", "pa"])
    presence = keys.groupBy("node", "part").agg(F.sum(B.column_bits("pa", "ta") + B.column_bits(F.col("p") - F.col("pa"), F.col("t") - F.col("ta"))).alias("presence"), F.count("*").alias("size"))
    # values, block by block
    c = supported.filter("owned").groupBy("node", "key", "value").agg(F.sum("n").alias("c"))
    ca = inside.filter("owned").groupBy("node", "part", "key", "value").agg(F.sum("n").alias("ca"))
    pairs = size.select("node", "part").join(c, "node").join(ca, ["node", "part", "key", "value"], "left").fillna(0, ["ca"])
    rest = F.col("c") - F.col("ca")
    blocks = pairs.groupBy("node", "part", "key").agg(F.sum("ca").alias("n1"), F.count_if(F.col("ca") > 0).alias("u1"), _bits(F.col("ca")).alias("s1"), F.sum(rest).alias("n2"), F.count_if(rest > 0).alias("u2"), _bits(rest).alias("s2")).join(objective.inventory(s.cells), "key")
    half = lambda i: F.when(F.col(f"n{i}") > 0, B.vblock_bits(F.col(f"s{i}"), F.col(f"n{i}"), F.col(f"u{i}"), B.naming_charge("inv"))).otherwise(0.0)
    values = blocks.groupBy("node", "part").agg(F.sum(half(1) + half(2)).alias("values"))
    before = objective.node_terms(s).select("node", (F.col("structure") + F.col("presence") + F.col("values")).alias("before"))
    j = size.join(presence, ["node", "part"]).join(values, ["node", "part"], "left").fillna(0.0, ["values"]).join(before, "node").crossJoin(F.broadcast(world))  # one row
    after = B.column_bits("ta", "n") + B.column_bits(F.col("t") - F.col("ta"), F.col("n")) + 2 * B.support_bits("size", "keys") + F.col("presence") + F.col("values")
    return j.select("node", "part", F.col("ta").alias("size"), (after - F.col("before") + objective._shape_delta(k, 1)).alias("delta"))


def proposals(s: State, most: int = SEEDS, two_means: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """parts (node, part, type), offered (node, offered), types and the members' types (node, rec_id, type) of all nodes."""
    typed = saved(member_types(s.cells, s.membership, s.owner))
    kinds = saved(types(typed))
    a = saved(atoms(kinds))
    t = s.membership.groupBy("node").agg(F.count("*").alias("t"))
    raw, offered = seeds(a, t, 2, most)
    raw = saved(raw)
    parts = grown(a, raw, objective.inventory(s.cells)).unionByName(raw.filter(~F.col("part").contains("=")).withColumn("part", F.concat("part", F.lit(" raw"))))
    if two_means:
        found = saved(means(kinds, a))
        parts = parts.unionByName(found)
        more = found.select("node", "part").distinct().groupBy("node").agg(F.count("*").alias("offered"))
        offered = offered.unionByName(more).groupBy("node").agg(F.sum("offered").alias("offered"))
    return saved(parts), offered, kinds, typed.select("node", "rec_id", "type")


def split_deltas(s: State, most: int = SEEDS, two_means: bool = True) -> DataFrame:
    """node, part, size, delta, charge: every proper part of every node, its exact change of the total, and the bits that name it."""
    parts, offered, kinds, _ = proposals(s, most, two_means)
    return deltas(s, kinds, atoms(kinds), parts).join(offered, "node").select("node", "part", "size", "delta", B.split_naming_charge("offered").alias("charge"))


def split_best(s: State, most: int = SEEDS) -> State | None:
    """The state after each node's best part became a node of its own (node/part), where that pays with its charge; None where none does."""
    parts, offered, kinds, typed = proposals(s, most)
    priced = deltas(s, kinds, atoms(kinds), parts).join(offered, "node").withColumn("bits", F.col("delta") + B.split_naming_charge("offered"))
    best = saved(priced.filter("bits < -1e-9").groupBy("node").agg(F.min_by("part", F.struct(F.round("bits", 9), "part")).alias("part")))
    if best.isEmpty():
        return None
    moved = saved(typed.join(parts.join(best, ["node", "part"]), ["node", "type"]).select("node", "rec_id", F.concat_ws("/", "node", "part").alias("target")))
    new = best.select("node", F.concat_ws("/", "node", "part").alias("target"))
    rename = lambda df: df.join(moved, ["node", "rec_id"], "left").withColumn("node", F.coalesce("target", "node")).drop("target")
    return State(s.cells, rename(s.membership).select("node", "rec_id"), s.support.select("node", "key").unionByName(s.support.join(new, "node").select(F.col("target").alias("node"), "key")), rename(s.owner).select("node", "rec_id", "key"))


# the residual


def residual(s: State) -> DataFrame:
    """rec_id of the records in no node."""
    return s.cells.select("rec_id").distinct().join(s.membership.select("rec_id").distinct(), "rec_id", "left_anti")


def residual_mint_deltas(s: State, most: int = SEEDS) -> DataFrame:
    """part, size, keys, delta, charge: new nodes out of the residual, with all keys of their members, by pairs grown once."""
    free = residual(s).withColumn("node", F.lit("residual"))
    owned = s.owner.select("rec_id", "key").distinct()
    taken = s.cells.join(owned, ["rec_id", "key"], "left_anti").select(F.lit("residual").alias("node"), "rec_id", "key")  # the background's
    kinds = saved(types(saved(member_types(s.cells, free, taken))))
    a = saved(atoms(kinds))
    t = free.groupBy("node").agg(F.count("*").alias("t"))
    raw, offered = seeds(a, t, 1, most, keys=False)
    parts = saved(grown(a, saved(raw), objective.inventory(s.cells)))
    return mint_deltas(s, kinds, a, parts, t).join(offered, "node").select("part", "size", "keys", "delta", B.split_naming_charge("offered").alias("charge"))


def mint_deltas(s: State, kinds: DataFrame, a: DataFrame, parts: DataFrame, t: DataFrame) -> DataFrame:
    """node, part, size, keys, delta: the change of the total if records of no node become one, out of the background."""
    world = s.cells.agg(F.count_distinct("rec_id").alias("n"), F.count_distinct("key").alias("all_keys"))
    nodes = s.membership.select("node").distinct().count()
    size = parts.join(kinds.select("node", "type", "n"), ["node", "type"]).groupBy("node", "part").agg(F.sum("n").alias("size")).join(t, "node").filter("size < t").drop("t")
    inside = parts.join(a, ["node", "type"])
    p = inside.groupBy("node", "part", "key").agg(F.sum("n").alias("p"))
    c = inside.filter("owned").groupBy("node", "part", "key", "value").agg(F.sum("n").alias("c"))
    free = s.cells.join(s.owner.select("rec_id", "key").distinct(), ["rec_id", "key"], "left_anti").groupBy("key", "value").agg(F.count("*").alias("b"))
    # every block of the background that a part takes cells from, before and after
    pairs = c.select("node", "part", "key").distinct().join(free, "key").join(c, ["node", "part", "key", "value"], "left").fillna(0, ["c"])
    rest = F.col("b") - F.col("c")
    blocks = pairs.groupBy("node", "part", "key").agg(*[x for name, y in (("c", F.col("c")), ("b", F.col("b")), ("r", rest)) for x in (F.sum(y).alias(f"n{name}"), F.count_if(y > 0).alias(f"u{name}"), _bits(y).alias(f"s{name}"))]).join(objective.inventory(s.cells), "key")
    block = lambda x: F.when(F.col(f"n{x}") > 0, B.vblock_bits(F.col(f"s{x}"), F.col(f"n{x}"), F.col(f"u{x}"), B.naming_charge("inv"))).otherwise(0.0)
    values = blocks.groupBy("node", "part").agg(F.sum(block("c") + block("r") - block("b")).alias("values"))
    cost = lambda ones, places: F.when(places > 0, B.column_bits(F.least(ones, places), places)).otherwise(0.0)
    bg = objective._background_counts(s)
    pres = p.join(size, ["node", "part"]).join(bg, "key").groupBy("node", "part").agg(
        F.sum(B.column_bits("p", "size") + cost(F.col("p0") - F.col("p"), F.col("n0") - F.col("size")) - cost(F.col("p0"), F.col("n0"))).alias("presence"), F.count("*").alias("keys"))
    j = size.join(pres, ["node", "part"]).join(values, ["node", "part"], "left").fillna(0.0, ["values"]).crossJoin(F.broadcast(world))  # one row
    return j.select("node", "part", "size", "keys", (B.column_bits("size", "n") + B.support_bits("keys", "all_keys") + F.col("presence") + F.col("values") + objective._shape_delta(nodes, 1)).alias("delta"))
