"""A hierarchy of groups on tables: links, members, supports, and one owner for every slot.

cells (rec_id, key, value), members (node, rec_id), support (node, key), links
(child, parent) and owners (rec_id, key, node). A slot is a record and a key,
whether the record has the key or not. Nodes that hold the record and support
the key may own it; a slot without a row in owners is the background's.

A state is valid when links have no cycle, a child's members are members of
each of its parents, links that others imply are left out, and owners may own
what they own (``violations`` names what breaks this). Moves are functions from
state to state; ``revisions`` says what differs.

Records with the same cells and the same nodes may stand as one (``alike``):
its rec_id is the smallest of theirs, and weight tells how many they are.
Routing, descriptions and the branch code count records by weight, so what
they read grows with the kinds of records and not with their number.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.sources.scratch import drop, saved

#: Bits of a snapshot's fixed frame: format name, version and checksum.
FRAME_BITS = 360
#: Memberships that one task takes. Tables of a state are so compact that files of a usual size hold tens of millions.
ROWS = 500_000


@dataclass(frozen=True)
class Owned:
    cells: DataFrame
    members: DataFrame
    support: DataFrame
    links: DataFrame
    owners: DataFrame
    #: rec_id, w: how many records it stands for; None: each for itself
    weight: DataFrame | None = None
    #: record, rec_id: what each record stands as; None: each as itself
    records: DataFrame | None = None


def settled(h: Owned) -> Owned:
    """The state written and read back, so that what follows starts from its tables and not from what led to them."""
    return replace(h, **{name: saved(getattr(h, name)) for name in ("cells", "members", "support", "links", "owners")})


def alike(cells: DataFrame, apart: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells (of one record of each kind), weight and records: records with the same cells and the same value of column apart are of a kind."""
    whole = saved(cells.groupBy("rec_id", apart).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("cells")))
    kinds = saved(whole.groupBy(apart, "cells").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("w")))
    records = whole.withColumnRenamed("rec_id", "record").join(kinds.select(apart, "cells", "rec_id"), [apart, "cells"]).select("record", "rec_id")
    return kinds.select("rec_id", F.explode("cells").alias("c"), apart).select("rec_id", "c.key", "c.value", apart), kinds.select("rec_id", "w"), records


def weighed(h: Owned, df: DataFrame) -> DataFrame:
    """df (with rec_id) with w, how many records stand there."""
    return df.withColumn("w", F.lit(1).cast("long")) if h.weight is None else df.join(h.weight.select("rec_id", "w"), "rec_id")


def size(h: Owned) -> DataFrame:
    """One row: n, how many records have cells."""
    return weighed(h, h.cells.select("rec_id").distinct()).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))


def dealt(members: DataFrame, rows: int = ROWS) -> int:
    """Into how many partitions the slots of members are dealt, so that a task's share is bounded."""
    return max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // rows))


# the graph of nodes


def ancestors(links: DataFrame) -> DataFrame:
    """node, ancestor: all that links reach. Each round doubles the length of the paths known; a cycle shows as node = ancestor."""
    reach = saved(links.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    n = reach.count()
    while True:
        on = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = saved(reach.unionByName(reach.join(on, "ancestor").select("node", F.col("further").alias("ancestor"))).distinct())
        more = longer.count()
        drop(reach)
        reach = longer
        if more == n:
            return reach
        n = more


def close_members(h: Owned, closure: DataFrame | None = None) -> Owned:
    """Every ancestor takes its descendants' members in."""
    up = closure if closure is not None else ancestors(h.links)
    inherited = h.members.join(up, "node").select(F.col("ancestor").alias("node"), "rec_id")
    return replace(h, members=h.members.select("node", "rec_id").unionByName(inherited).distinct())


def reduce_links(h: Owned, closure: DataFrame | None = None) -> Owned:
    """Without links to an ancestor of another parent."""
    up = closure if closure is not None else ancestors(h.links)
    links = h.links.select("child", "parent").distinct()
    implied = links.withColumnRenamed("parent", "node").join(up, "node").select("child", F.col("ancestor").alias("parent"))
    return replace(h, links=links.join(implied.distinct(), ["child", "parent"], "left_anti"))


def depths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, depth: 1 for nodes without parents, else one more than the deepest parent's; level by level."""
    level, k = saved(nodes.select("node", F.lit(1).alias("depth"))), 1
    most = level.count()
    while True:
        lower = level.filter(F.col("depth") == k).select(F.col("node").alias("parent")).join(links, "parent").select(F.col("child").alias("node"), F.lit(k + 1).alias("deeper")).distinct()
        after = saved(level.join(lower, "node", "left").select("node", F.coalesce("deeper", "depth").alias("depth")))
        drop(level)
        level, k = after, k + 1
        if level.filter(F.col("depth") == k).isEmpty():
            return level
        if k > most:
            raise ValueError("the links have a cycle")


# slots


def eligible_rows(h: Owned) -> DataFrame:
    """node, eligible: how many records are in all of the node's parents (all records, for a node without any)."""
    parents = h.links.groupBy("child").agg(F.count("*").alias("k"))
    inside = h.links.join(h.members.withColumnRenamed("node", "parent"), "parent").groupBy("child", "rec_id").agg(F.count("*").alias("k"))
    counted = weighed(h, inside.join(parents, ["child", "k"])).groupBy(F.col("child").alias("node")).agg(F.sum("w").alias("inside"))
    n = size(h)
    nodes = h.members.select("node").distinct().join(parents.select(F.col("child").alias("node"), "k"), "node", "left").join(counted, "node", "left").crossJoin(F.broadcast(n))  # one row
    return nodes.select("node", F.when(F.col("k").isNull(), F.col("n")).otherwise(F.coalesce("inside", F.lit(0))).alias("eligible"))


def eligible_owners(h: Owned) -> DataFrame:
    """rec_id, key, eligible: the nodes that may own the slot, sorted; slots that none may own are left out."""
    members = h.members.repartition(dealt(h.members), "rec_id")
    return members.join(F.broadcast(h.support), "node").groupBy("rec_id", "key").agg(F.array_sort(F.collect_list("node")).alias("eligible"))  # support: a row for each node and key


def route(h: Owned, nodes: DataFrame) -> Owned:
    """All slots of the given nodes (column node) go to them; where two of them meet, to the one that sorts first."""
    theirs = h.members.join(h.support, "node").join(nodes.select("node").distinct(), "node", "left_semi").groupBy("rec_id", "key").agg(F.min("node").alias("node"))
    rest = h.owners.join(theirs, ["rec_id", "key"], "left_anti")
    return replace(h, owners=rest.select("rec_id", "key", "node").unionByName(theirs.select("rec_id", "key", "node")))


def route_specific(h: Owned) -> Owned:
    """Every slot goes to the eligible node with the fewest members; of equal ones to the one that sorts first."""
    t = weighed(h, h.members).groupBy("node").agg(F.sum("w").alias("t"))
    ranked = saved(t.select("node", F.row_number().over(Window.orderBy("t", "node")).alias("rank")))  # a row for each node
    members = h.members.repartition(dealt(h.members), "rec_id")
    best = members.join(F.broadcast(h.support.join(ranked, "node")), "node").groupBy("rec_id", "key").agg(F.min("rank").alias("rank"))
    return replace(h, owners=best.join(F.broadcast(ranked), "rank").select("rec_id", "key", "node"))


def route_cheapest(h: Owned) -> Owned:
    """Every slot goes where what it holds costs fewest bits: under the counts of a node's members, or the background's.

    Counts are those of all members, whoever owns their slots, so slots are
    decided side by side. Ties: the background, then fewer members, then order.
    """
    n = size(h)
    hist = weighed(h, h.cells).groupBy("key", "value").agg(F.sum("w").alias("c"))
    keys = hist.groupBy("key").agg(F.sum("c").alias("p"), F.count("*").alias("d")).crossJoin(F.broadcast(n))  # one row
    log2_share = lambda c, total, d: -F.log2((c + 0.5) / (total + d / 2))
    t = weighed(h, h.members).groupBy("node").agg(F.sum("w").alias("t"))
    inside = h.members.join(h.support, "node").join(h.cells, ["rec_id", "key"], "left").select("node", "rec_id", "key", "value")
    seen = weighed(h, inside).groupBy("node", "key", "value").agg(F.sum("w").alias("nc"))
    total = seen.filter("value IS NOT NULL").groupBy("node", "key").agg(F.sum("nc").alias("np"))
    common = keys.join(hist, "key").select("key", "value", (log2_share(F.col("p"), F.col("n"), F.lit(2)) + log2_share(F.col("c"), F.col("p"), F.col("d"))).alias("common"))
    absent = keys.select("key", F.lit(None).cast("string").alias("value"), log2_share(F.col("n") - F.col("p"), F.col("n"), F.lit(2)).alias("common"))
    priced = seen.join(total, ["node", "key"], "left").fillna(0, ["np"]).join(t, "node").join(keys.select("key", "d"), "key")
    own = F.when(F.col("value").isNull(), log2_share(F.col("t") - F.col("np"), F.col("t"), F.lit(2))).otherwise(log2_share(F.col("np"), F.col("t"), F.lit(2)) + log2_share(F.col("nc"), F.col("np"), F.col("d")))
    costs = priced.select("node", "key", "value", "t", F.round(own, 9).alias("bits")).alias("a").join(
        common.unionByName(absent).withColumnRenamed("key", "ck").withColumnRenamed("value", "cv").alias("b"), (F.col("key") == F.col("ck")) & F.col("value").eqNullSafe(F.col("cv"))
    ).select("node", "key", "value", "t", "bits", F.round("common", 9).alias("common"))
    better = costs.filter("bits < common").withColumnsRenamed({"node": "n2", "key": "k2", "value": "v2"})
    slot = inside.join(better, (F.col("node") == F.col("n2")) & (F.col("key") == F.col("k2")) & F.col("value").eqNullSafe(F.col("v2")))
    best = slot.groupBy("rec_id", "key").agg(F.min(F.struct("bits", "t", "node")).alias("best"))
    return replace(h, owners=best.select("rec_id", "key", F.col("best.node").alias("node")))


def clean_owners(h: Owned) -> Owned:
    """Without owners that may not own their slot: not a member, or without the key."""
    kept = h.owners.join(h.members.select("node", "rec_id"), ["node", "rec_id"], "left_semi").join(h.support.select("node", "key"), ["node", "key"], "left_semi")
    return replace(h, owners=kept.select("rec_id", "key", "node"))


def violations(h: Owned) -> DataFrame:
    """what, node, rec_id, key of everything that a valid state has not."""
    up = ancestors(h.links)
    empty = lambda what, df, node="node", rec=None, key=None: df.select(F.lit(what).alias("what"), F.col(node).cast("string").alias("node"), (F.col(rec) if rec else F.lit(None)).cast("long").alias("rec_id"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"))
    cycle = empty("cycle", up.filter("node = ancestor"))
    outside = h.links.join(h.members.withColumnRenamed("node", "child"), "child").join(h.members.withColumnRenamed("node", "parent"), ["parent", "rec_id"], "left_anti")
    implied = h.links.join(reduce_links(h, up).links, ["child", "parent"], "left_anti")
    stranger = h.owners.join(clean_owners(h).owners, ["rec_id", "key", "node"], "left_anti")
    twice = h.owners.groupBy("rec_id", "key").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c > 1")
    return cycle.unionByName(empty("member outside a parent", outside, "child", "rec_id")).unionByName(empty("implied link", implied, "child")).unionByName(empty("owner may not own", stranger, "node", "rec_id", "key")).unionByName(empty("two owners", twice, "node", "rec_id", "key"))


# moves


def create(h: Owned, members: DataFrame, support: DataFrame, links: DataFrame | None = None, routed: bool = True) -> Owned:
    """New nodes; with ``routed`` they own all their slots."""
    out = replace(h, members=h.members.unionByName(members), support=h.support.unionByName(support), links=h.links if links is None else h.links.unionByName(links))
    out = close_members(reduce_links(out)) if links is not None else out
    return route(out, members) if routed else out


def delete(h: Owned, nodes: DataFrame) -> Owned:
    """Without the given nodes; children take over the nearest ancestors that stay, and slots go to the background."""
    gone = saved(nodes.select("node").distinct())
    is_gone = lambda df, c: df.join(gone.withColumnRenamed("node", c), c, "left_semi")
    stays = lambda df, c: df.join(gone.withColumnRenamed("node", c), c, "left_anti")
    through = stays(ancestors(is_gone(h.links, "child")), "ancestor")  # paths whose inner nodes are all gone
    taken = stays(is_gone(h.links, "parent"), "child").withColumnRenamed("parent", "node").join(through, "node").select("child", F.col("ancestor").alias("parent"))
    kept = stays(stays(h.links, "child"), "parent").select("child", "parent")
    out = replace(h, members=stays(h.members, "node"), support=stays(h.support, "node"), links=kept.unionByName(taken).distinct(), owners=stays(h.owners, "node"))
    return reduce_links(out)


def revisions(before: Owned, after: Owned) -> DataFrame:
    """what, node, rec_id, key, before, after: every membership, owner, link and node that differs."""
    n = dealt(before.members)
    null = lambda kind: F.lit(None).cast(kind)

    def changed(what: str, a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        deal = lambda df: df.select(*by).repartition(n, *by) if "rec_id" in by else df.select(*by)
        a, b = deal(a).distinct().withColumn("in_a", F.lit(True)), deal(b).distinct().withColumn("in_b", F.lit(True))
        j = a.join(b, by, "full").filter("in_a IS NULL OR in_b IS NULL")
        col = lambda c, kind: F.col(c).cast(kind) if c in by else null(kind)
        name = F.col("child").cast("string") if "child" in by else F.col("node").cast("string")
        other = F.col("parent").cast("string") if "child" in by else F.lit("there")
        return j.select(F.lit(what).alias("what"), name.alias("node"), col("rec_id", "long").alias("rec_id"), col("key", "string").alias("key"), F.when(F.col("in_a"), other).alias("before"), F.when(F.col("in_b"), other).alias("after"))

    slots = lambda h, name: h.owners.withColumnRenamed("node", name).repartition(n, "rec_id", "key")
    owner = slots(before, "before").join(slots(after, "after"), ["rec_id", "key"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    owners = owner.select(F.lit("owner").alias("what"), null("string").alias("node"), F.col("rec_id").cast("long"), F.col("key").cast("string"), F.col("before").cast("string"), F.col("after").cast("string"))
    nodes = lambda h: h.members.select("node").distinct()
    return owners.unionByName(changed("member", before.members, after.members, ["node", "rec_id"])).unionByName(changed("link", before.links, after.links, ["child", "parent"])).unionByName(changed("node", nodes(before), nodes(after), ["node"]))


# description


def _kt(terms: Column, total: Column, size: Column) -> Column:
    return F.when(size > 1, B.kt_block(terms, total, size)).otherwise(0.0)


def description(h: Owned) -> DataFrame:
    """One row: bits of header, structure, membership, ownership, presence and values, and their total.

    The header carries every key's histogram, and the background uses it as it
    is. Owners are told apart slot by slot, given which nodes may own it; a
    node's own slots have adaptive blocks of presence and of values.

    All slots are met once, on (rec_id, key); what the terms need of them is
    one table of counts by key, eligible nodes, owner and value.
    """
    hist = saved(weighed(h, h.cells).groupBy("key", "value").agg(F.sum("w").alias("c")))
    keys = saved(hist.groupBy("key").agg(F.sum("c").alias("p"), F.count("*").alias("d"), F.sum(B.string_bits("value") + B.elias_gamma("c")).alias("header")))
    n = saved(size(h))
    slots = eligible_owners(h).join(h.owners, ["rec_id", "key"], "left").join(h.cells.select("rec_id", "key", "value"), ["rec_id", "key"], "left")
    counts = saved(weighed(h, slots).groupBy("key", "eligible", "node", "value").agg(F.sum("w").alias("c")))

    header = keys.agg(F.coalesce(F.sum(F.col("header") + B.string_bits("key") + B.elias_gamma("d")), F.lit(0.0)).alias("header"), F.count("*").alias("keys")).crossJoin(n)  # one row each
    header = header.select((F.col("header") + FRAME_BITS + B.elias_gamma("n") + B.elias_gamma("keys")).alias("header"), "n", "keys")

    sizes = weighed(h, h.members).groupBy("node").agg(F.sum("w").alias("t")).join(h.support.groupBy("node").agg(F.count("*").alias("size")), "node", "left").fillna(0, ["size"]).join(eligible_rows(h), "node")
    graph = sizes.crossJoin(F.broadcast(header.select("keys"))).agg(F.count("*").alias("k"), F.coalesce(F.sum(B.binary_bits("size", "keys")), F.lit(0.0)).alias("supports"), F.coalesce(F.sum(B.binary_bits("t", "eligible")), F.lit(0.0)).alias("membership")).crossJoin(h.links.agg(F.count("*").alias("links")))
    graph = graph.select((B.elias_gamma("k") + B.binary_bits("links", F.floor(F.col("k") * (F.col("k") - 1) / 2)) + F.col("supports")).alias("structure"), "membership")

    chosen = counts.groupBy("key", "eligible", "node").agg(F.sum("c").alias("c")).groupBy("key", "eligible").agg(F.sum(B.kt_block_term("c")).alias("s"), F.sum("c").alias("total"))
    ownership = chosen.agg(F.coalesce(F.sum(B.kt_block(F.col("s"), F.col("total"), F.size("eligible") + 1)), F.lit(0.0)).alias("ownership"))

    mine = counts.filter("node IS NOT NULL")
    blocks = mine.groupBy("node", "key").agg(F.sum("c").alias("slots"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("ones"))
    presence = blocks.agg(F.coalesce(F.sum(B.binary_bits("ones", "slots")), F.lit(0.0)).alias("bits"))
    valued = mine.filter("value IS NOT NULL").groupBy("node", "key", "value").agg(F.sum("c").alias("c")).groupBy("node", "key").agg(F.sum(B.kt_block_term("c")).alias("s"), F.sum("c").alias("total"))
    values = valued.join(keys.select("key", "d"), "key").agg(F.coalesce(F.sum(_kt(F.col("s"), F.col("total"), F.col("d"))), F.lit(0.0)).alias("bits"))

    owned = blocks.groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("slots").alias("slots"))
    left = keys.join(owned, "key", "left").fillna(0, ["ones", "slots"]).crossJoin(F.broadcast(n))  # one row
    share = (F.col("p") + 0.5) / (F.col("n") + 1)
    common_presence = left.agg(F.coalesce(-F.sum((F.col("p") - F.col("ones")) * F.log2(share) + (F.col("n") - F.col("p") - F.col("slots") + F.col("ones")) * F.log2(1 - share)), F.lit(0.0)).alias("bits"))
    taken = mine.filter("value IS NOT NULL").groupBy("key", "value").agg(F.sum("c").alias("taken"))
    rest = hist.join(taken, ["key", "value"], "left").fillna(0, ["taken"]).join(keys.select("key", "p", "d"), "key")
    common_values = rest.agg(F.coalesce(-F.sum((F.col("c") - F.col("taken")) * F.log2((F.col("c") + 0.5) / (F.col("p") + F.col("d") / 2))), F.lit(0.0)).alias("bits"))

    both = lambda a, b, name: a.crossJoin(b.withColumnRenamed("bits", "more")).select((F.col("bits") + F.col("more")).alias(name))  # noqa: E731  one row each
    row = header.select("header").crossJoin(graph).crossJoin(ownership).crossJoin(both(presence, common_presence, "presence")).crossJoin(both(values, common_values, "values"))
    terms = ("header", "structure", "membership", "ownership", "presence", "values")
    return row.withColumn("total", sum((F.col(t) for t in terms), F.lit(0.0)))


# proposals


def pooled_keys(h: Owned, families: DataFrame) -> DataFrame:
    """family, key, saved: keys whose values cost less in one block for the family's nodes (family, node) than in one for each."""
    d = h.cells.groupBy("key").agg(F.count_distinct("value").alias("d"))
    counts = families.select("family", "node").distinct().join(h.members, "node").join(h.cells, "rec_id").groupBy("family", "node", "key", "value").agg(F.count("*").alias("c"))
    block = lambda df, by: df.groupBy(*by, "key").agg(F.sum(B.kt_block_term("c")).alias("s"), F.sum("c").alias("n")).join(d, "key").select(*by, "key", _kt(F.col("s"), F.col("n"), F.col("d")).alias("bits"))
    apart = block(counts, ["family", "node"]).groupBy("family", "key").agg(F.sum("bits").alias("apart"))
    together = block(counts.groupBy("family", "key", "value").agg(F.sum("c").alias("c")), ["family"])
    return together.join(apart, ["family", "key"]).select("family", "key", (F.col("apart") - F.col("bits")).alias("saved")).filter("saved > 1e-9")


def grown(cells: DataFrame, members: DataFrame, universe: DataFrame) -> DataFrame:
    """grp, rec_id, odds: the records of each group's universe that are likelier inside, by one step of naive Bayes.

    members and universe: (grp, rec_id). A missing key counts as one more value
    of the key. A record without any key has its group's base odds; each cell
    that it has changes them by the difference to the missing one.
    """
    part = universe.select("grp", "rec_id").join(members.select("grp", "rec_id").withColumn("inside", F.lit(1)), ["grp", "rec_id"], "left").fillna(0, ["inside"])
    size = part.groupBy("grp").agg(F.count("*").alias("n"), F.sum("inside").alias("t"))
    held = part.join(cells, "rec_id")
    seen = held.groupBy("grp", "key", "value").agg(F.sum("inside").alias("a"), F.sum(1 - F.col("inside")).alias("b"))
    per_key = seen.groupBy("grp", "key").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"), F.count("*").alias("u")).join(size, "grp")
    d = F.col("u") + F.when(F.col("pa") + F.col("pb") < F.col("n"), 1).otherwise(0)
    per_key = per_key.withColumn("d", d)
    odds = lambda a, b: F.log((a + 0.5) / (F.col("t") + F.col("d") / 2)) - F.log((b + 0.5) / (F.col("n") - F.col("t") + F.col("d") / 2))
    none = per_key.withColumn("none", F.when(F.col("pa") + F.col("pb") < F.col("n"), odds(F.col("t") - F.col("pa"), F.col("n") - F.col("t") - F.col("pb"))).otherwise(0.0))
    base = none.groupBy("grp").agg(F.sum("none").alias("base")).join(size, "grp", "right").select("grp", (F.coalesce("base", F.lit(0.0)) + F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5))).alias("base"))
    gain = seen.join(none, ["grp", "key"]).select("grp", "key", "value", (odds(F.col("a"), F.col("b")) - F.col("none")).alias("gain"))
    mine = held.join(gain, ["grp", "key", "value"]).groupBy("grp", "rec_id").agg(F.sum("gain").alias("gain"))
    return part.select("grp", "rec_id").join(mine, ["grp", "rec_id"], "left").fillna(0.0, ["gain"]).join(base, "grp").select("grp", "rec_id", (F.col("base") + F.col("gain")).alias("odds")).filter("odds > 0")
