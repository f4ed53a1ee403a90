"""Queries about hierarchies, splits, moves, snapshots and simulations, with DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.operators import accounts, branches, levels, nearest, nulls, objective, predictive, snapshots, splits
from bitquarry.operators import ownership as O
from bitquarry.plans import duck as D
from bitquarry.plans.catalogue import query, r6
from bitquarry.sources import records as R
from bitquarry.sources.scratch import saved

# a hierarchy over the mixed stream: places over customers and suppliers, statuses over orders

#: Keys that each kind of node supports (some that its records never have).
SUPPORTS = {"cust": ("segment", "nation"), "supp": ("nation", "brand"), "reg": ("region", "nation"), "customer": ("segment", "region"), "geo": ("nation", "region", "prio"), "ord": ("status", "prio"), "orders": ("prio", "status", "year")}


def places(spark: SparkSession, sf_dir: str, alike: bool = False) -> O.Owned:
    """Leaves hold members, and their ancestors take these in; one link of each customers' leaf is implied by others and goes. alike: equal records of a table stand as one."""
    cells, weight, records = O.alike(R.mixed(spark, sf_dir), "truth") if alike else (saved(R.mixed(spark, sf_dir)), None, None)
    name = lambda kind: F.concat(F.lit(kind + ":"), "value")
    of = lambda truth, key, kind: cells.filter((F.col("truth") == truth) & (F.col("key") == key)).select(name(kind).alias("node"), "rec_id", "value")
    leaves = of("customer", "region", "cust").unionByName(of("supplier", "region", "supp")).unionByName(of("orders", "status", "ord"))
    kinds = leaves.select(F.split("node", ":")[0].alias("kind"), "node", "value").distinct()
    up = F.when(F.col("kind") == "cust", F.array(name("reg"), F.lit("customer"), F.lit("geo"))).when(F.col("kind") == "supp", F.array(name("reg"))).otherwise(F.array(F.lit("orders")))
    low = kinds.select(F.col("node").alias("child"), F.explode(up).alias("parent"))
    high = low.filter("parent LIKE 'reg:%' OR parent = 'customer'").select(F.col("parent").alias("child"), F.lit("geo").alias("parent")).distinct()
    links = saved(low.unionByName(high))
    keys = spark.createDataFrame([(kind, key) for kind, ks in SUPPORTS.items() for key in ks], "kind string, key string")
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    support = nodes.withColumn("kind", F.split("node", ":")[0]).join(F.broadcast(keys), "kind").select("node", "key")
    raw = O.Owned(cells.select("rec_id", "key", "value"), leaves.select("node", "rec_id"), support, links, spark.createDataFrame([], "rec_id long, key string, node string"), weight, records)
    closure = O.ancestors(links)
    return O.settled(O.reduce_links(O.close_members(raw, closure), closure))


_KINDS = ", ".join(f"('{kind}', '{key}')" for kind, ks in SUPPORTS.items() for key in ks)

_PLACES = f"""cells AS MATERIALIZED ({D.MIXED}),
leaf AS (SELECT CASE truth WHEN 'customer' THEN 'cust:' WHEN 'supplier' THEN 'supp:' ELSE 'ord:' END || value AS node, rec_id, value FROM cells WHERE (truth IN ('customer', 'supplier') AND key = 'region') OR (truth = 'orders' AND key = 'status')),
low AS (SELECT DISTINCT node AS child, unnest(CASE split_part(node, ':', 1) WHEN 'cust' THEN ['reg:' || value, 'customer', 'geo'] WHEN 'supp' THEN ['reg:' || value] ELSE ['orders'] END) AS parent FROM leaf),
links0 AS (SELECT * FROM low UNION SELECT parent, 'geo' FROM low WHERE parent LIKE 'reg:%' OR parent = 'customer'),
anc(node, ancestor) AS (SELECT child, parent FROM links0 UNION SELECT anc.node, l.parent FROM anc JOIN links0 l ON anc.ancestor = l.child),
links AS (SELECT child, parent FROM links0 EXCEPT SELECT l.child, anc.ancestor FROM links0 l JOIN anc ON anc.node = l.parent),
members AS MATERIALIZED (SELECT node, rec_id FROM leaf UNION SELECT anc.ancestor, l.rec_id FROM leaf l JOIN anc ON anc.node = l.node),
t AS (SELECT node, count(*) AS t FROM members GROUP BY node),
support AS (SELECT t.node, k.key FROM t JOIN (VALUES {_KINDS}) k(kind, key) ON split_part(t.node, ':', 1) = k.kind),
kn AS (SELECT count(DISTINCT rec_id) AS n FROM cells),
hist AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2),
keys AS (SELECT key, sum(c) AS p, count(*) AS d FROM hist GROUP BY 1),
slots AS MATERIALIZED (SELECT m.rec_id, s.key, m.node, t.t, c.value FROM members m JOIN support s ON s.node = m.node JOIN t ON t.node = m.node LEFT JOIN cells c ON c.rec_id = m.rec_id AND c.key = s.key)"""

_SPECIFIC = "specific AS (SELECT rec_id, key, arg_min(node, struct_pack(t := t, v := node)) AS node FROM slots GROUP BY 1, 2)"

_CHEAPEST = """seen AS (SELECT node, key, value, any_value(t) AS t, count(*) AS nc FROM slots GROUP BY 1, 2, 3),
np AS (SELECT node, key, sum(nc) FILTER (WHERE value IS NOT NULL) AS np FROM seen GROUP BY 1, 2),
priced AS (SELECT s.node, s.key, s.value, s.t, round(CASE WHEN s.value IS NULL THEN -log2((s.t - coalesce(np, 0) + 0.5) / (s.t + 1)) ELSE -log2((np + 0.5) / (s.t + 1)) - log2((nc + 0.5) / (np + d / 2)) END, 9) AS bits,
    round(CASE WHEN s.value IS NULL THEN -log2((n - p + 0.5) / (n + 1)) ELSE -log2((p + 0.5) / (n + 1)) - log2((h.c + 0.5) / (p + d / 2)) END, 9) AS common
    FROM seen s JOIN np ON np.node = s.node AND np.key = s.key JOIN keys ON keys.key = s.key CROSS JOIN kn LEFT JOIN hist h ON h.key = s.key AND h.value = s.value),
owners AS MATERIALIZED (SELECT s.rec_id, s.key, arg_min(s.node, struct_pack(b := bits, t := s.t, v := s.node)) AS node FROM slots s JOIN priced p ON p.node = s.node AND p.key = s.key AND p.value IS NOT DISTINCT FROM s.value WHERE bits < common GROUP BY 1, 2)"""

_GAMMA = "(2 * floor(log2({0} + 1)) + 1)"
_STRING = "(8 * strlen({0}) + 2 * floor(log2(strlen({0}) + 1)) + 1)"


def _bin(ones: str, total: str) -> str:
    return D.ktblock(f"{_half(ones)} + {_half(f'({total} - {ones})')}", total, "2")


def _half(c: str) -> str:
    return D.term(c)


_DESCRIPTION = f"""
el AS (SELECT rec_id, key, list_sort(list(node)) AS eligible, any_value(value) AS value FROM slots GROUP BY 1, 2),
ct AS MATERIALIZED (SELECT el.key, eligible, o.node, value, count(*) AS c FROM el LEFT JOIN owners o ON o.rec_id = el.rec_id AND o.key = el.key GROUP BY 1, 2, 3, 4),
er AS (SELECT t.node, t.t, CASE WHEN k IS NULL THEN n ELSE coalesce(inside, 0) END AS eligible FROM t CROSS JOIN kn LEFT JOIN (SELECT child, count(*) AS k FROM links GROUP BY 1) l ON l.child = t.node
    LEFT JOIN (SELECT child, count(*) AS inside FROM (SELECT l.child, m.rec_id, count(*) AS k FROM links l JOIN members m ON m.node = l.parent GROUP BY 1, 2) x JOIN (SELECT child, count(*) AS k FROM links GROUP BY 1) y USING (child, k) GROUP BY 1) i ON i.child = t.node),
sz AS (SELECT node, count(*) AS size FROM support GROUP BY 1),
hd AS (SELECT 360 + {_GAMMA.format('(SELECT n FROM kn)')} + {_GAMMA.format('(SELECT count(*) FROM keys)')} + (SELECT sum({_STRING.format('key')} + {_GAMMA.format('d')}) FROM keys) + (SELECT sum({_STRING.format('value')} + {_GAMMA.format('c')}) FROM hist) AS header),
st AS (SELECT {_GAMMA.format('k')} + {_bin('l', '(k * (k - 1) // 2)')} + s AS structure FROM (SELECT (SELECT count(*) FROM t) AS k, (SELECT count(*) FROM links) AS l, (SELECT sum({_bin('size', '(SELECT count(*) FROM keys)')}) FROM sz) AS s)),
mb AS (SELECT sum({_bin('t', 'eligible')}) AS membership FROM er),
ow AS (SELECT sum({D.ktblock('s', 'total', '(len(eligible) + 1)')}) AS ownership FROM (SELECT key, eligible, sum({_half('c')}) AS s, sum(c) AS total FROM (SELECT key, eligible, node, sum(c) AS c FROM ct GROUP BY 1, 2, 3) GROUP BY 1, 2)),
bl AS (SELECT node, key, sum(c) AS slots, coalesce(sum(c) FILTER (WHERE value IS NOT NULL), 0) AS ones FROM ct WHERE node IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT sum({_bin('ones', 'slots')}) AS bits FROM bl),
vl AS (SELECT sum(CASE WHEN d > 1 THEN {D.ktblock('s', 'total', 'd')} ELSE 0 END) AS bits FROM (SELECT node, key, sum({_half('c')}) AS s, sum(c) AS total FROM (SELECT node, key, value, sum(c) AS c FROM ct WHERE node IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN keys USING (key)),
cp AS (SELECT -sum((p - ones) * log2((p + 0.5) / (n + 1)) + (n - p - slots + ones) * log2(1 - (p + 0.5) / (n + 1))) AS bits FROM (SELECT key, any_value(p) AS p, coalesce(sum(ones), 0) AS ones, coalesce(sum(slots), 0) AS slots FROM keys LEFT JOIN bl USING (key) GROUP BY 1) CROSS JOIN kn),
cv AS (SELECT -sum((c - coalesce(taken, 0)) * log2((c + 0.5) / (p + d / 2))) AS bits FROM hist JOIN keys USING (key) LEFT JOIN (SELECT key, value, sum(c) AS taken FROM ct WHERE node IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2) USING (key, value)),
al AS (SELECT header, structure, membership, ownership, pr.bits + cp.bits AS presence, vl.bits + cv.bits AS values FROM hd, st, mb, ow, pr, cp, vl, cv)"""


@query(f"WITH RECURSIVE {_PLACES}, {_CHEAPEST}, {_DESCRIPTION} SELECT round(header, 6) AS header, round(structure, 6) AS structure, round(membership, 6) AS membership, round(ownership, 6) AS ownership, round(presence, 6) AS presence, round(values, 6) AS values, round(header + structure + membership + ownership + presence + values, 6) AS total FROM al")
def hierarchy_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = O.settled(O.route_cheapest(places(spark, sf_dir, alike=True)))
    return O.description(h).select(*[r6(c).alias(c) for c in ("header", "structure", "membership", "ownership", "presence", "values", "total")])


@query(f"WITH RECURSIVE {_PLACES}, {_SPECIFIC} SELECT key, eligible, node AS owner, count(*) AS slots, count(value) AS cells FROM (SELECT rec_id, key, array_to_string(list_sort(list(node)), ',') AS eligible, any_value(value) AS value FROM slots GROUP BY 1, 2) JOIN specific USING (rec_id, key) GROUP BY 1, 2, 3")
def slot_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = O.route_specific(places(spark, sf_dir))
    n = O.dealt(h.members)
    deal = lambda df: df.repartition(n, "rec_id", "key")
    slots = deal(O.eligible_owners(h)).join(deal(h.owners), ["rec_id", "key"]).join(deal(h.cells), ["rec_id", "key"], "left")
    return slots.groupBy("key", F.array_join("eligible", ",").alias("eligible"), F.col("node").alias("owner")).agg(F.count("*").alias("slots"), F.count("value").alias("cells"))


_REVISED = f"""{_SPECIFIC},
routed AS (SELECT rec_id, key, node FROM slots WHERE node = 'customer' UNION ALL SELECT rec_id, key, node FROM specific s WHERE NOT EXISTS (SELECT 1 FROM slots x WHERE x.node = 'customer' AND x.rec_id = s.rec_id AND x.key = s.key)),
gone AS (SELECT node FROM t WHERE node LIKE 'reg:%'),
after AS (SELECT * FROM routed WHERE node NOT IN (SELECT node FROM gone)),
lk AS (SELECT child, parent FROM links WHERE parent NOT IN (SELECT node FROM gone) AND child NOT IN (SELECT node FROM gone) UNION SELECT l.child, 'geo' FROM links l WHERE l.parent IN (SELECT node FROM gone) AND l.child LIKE 'supp:%'),
rv AS (SELECT 'owner' AS what, NULL AS node, rec_id, key, s.node AS before, a.node AS after FROM specific s FULL JOIN after a USING (rec_id, key) WHERE s.node IS DISTINCT FROM a.node
UNION ALL SELECT 'member', node, rec_id, NULL, 'there', NULL FROM members WHERE node IN (SELECT node FROM gone)
UNION ALL SELECT 'link', coalesce(l.child, k.child), NULL, NULL, l.parent, k.parent FROM links l FULL JOIN lk k ON l.child = k.child AND l.parent = k.parent WHERE l.child IS NULL OR k.child IS NULL
UNION ALL SELECT 'node', node, NULL, NULL, 'there', NULL FROM gone)"""


@query(f"WITH RECURSIVE {_PLACES}, {_REVISED} SELECT what, node, rec_id, key, before, after FROM rv")
def hierarchy_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' own slots go to their node, and the nodes of regions go: all that changes by it."""
    before = O.route_specific(places(spark, sf_dir))
    before = replace(before, owners=saved(before.owners))
    one = spark.createDataFrame([("customer",)], "node string")
    after = O.delete(O.route(before, one), before.members.select("node").filter("node LIKE 'reg:%'").distinct())
    return O.revisions(before, after)


@query(f"""WITH RECURSIVE {_PLACES}, fm AS (SELECT parent AS family, child AS node FROM links),
fc AS (SELECT family, f.node, key, value, count(*) AS c FROM fm f JOIN members m ON m.node = f.node JOIN cells c ON c.rec_id = m.rec_id GROUP BY 1, 2, 3, 4),
ap AS (SELECT family, key, sum(CASE WHEN d > 1 THEN {D.ktblock('s', 'n', 'd')} ELSE 0 END) AS apart FROM (SELECT family, node, key, sum({_half('c')}) AS s, sum(c) AS n FROM fc GROUP BY 1, 2, 3) JOIN keys USING (key) GROUP BY 1, 2),
tg AS (SELECT family, key, CASE WHEN d > 1 THEN {D.ktblock('s', 'n', 'd')} ELSE 0 END AS together FROM (SELECT family, key, sum({_half('c')}) AS s, sum(c) AS n FROM (SELECT family, key, value, sum(c) AS c FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN keys USING (key))
SELECT family, key, round(apart - together, 6) AS saved FROM tg JOIN ap USING (family, key) WHERE apart - together > 1e-9""")
def pooled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a parent's children share a block of to their gain."""
    h = places(spark, sf_dir)
    return O.pooled_keys(h, h.links.select(F.col("parent").alias("family"), F.col("child").alias("node"))).select("family", "key", r6("saved").alias("saved"))


_GAPPY = f"SELECT * FROM ({D.CUSTOMER}) WHERE NOT (key = 'nation' AND rec_id % 5 = 0)"


@query(f"""WITH cells AS MATERIALIZED ({_GAPPY}), rc AS (SELECT DISTINCT rec_id FROM cells),
pt AS (SELECT r_name AS grp, rc.rec_id, CASE WHEN c.value = r_name AND rc.rec_id % 2 = 0 THEN 1 ELSE 0 END AS i FROM region CROSS JOIN rc JOIN cells c ON c.rec_id = rc.rec_id AND c.key = 'region'),
sz AS (SELECT grp, count(*) AS n, sum(i) AS t FROM pt GROUP BY 1),
fl AS MATERIALIZED (SELECT pt.grp, pt.rec_id, i, k.key, c.value FROM pt CROSS JOIN (SELECT DISTINCT key FROM cells) k LEFT JOIN cells c ON c.rec_id = pt.rec_id AND c.key = k.key),
ab AS (SELECT grp, key, value, sum(i) AS a, sum(1 - i) AS b FROM fl GROUP BY 1, 2, 3), ds AS (SELECT grp, key, count(*) AS d FROM ab GROUP BY 1, 2),
lg AS (SELECT ab.grp, ab.key, value, ln((a + 0.5) / (t + d / 2.0)) - ln((b + 0.5) / (n - t + d / 2.0)) AS o FROM ab JOIN ds ON ds.grp = ab.grp AND ds.key = ab.key JOIN sz ON sz.grp = ab.grp),
od AS (SELECT fl.grp, fl.rec_id, sum(o) AS o FROM fl JOIN lg ON lg.grp = fl.grp AND lg.key = fl.key AND lg.value IS NOT DISTINCT FROM fl.value GROUP BY 1, 2)
SELECT od.grp, rec_id, round(o + ln((t + 0.5) / (n - t + 0.5)), 6) AS odds FROM od JOIN sz ON sz.grp = od.grp WHERE o + ln((t + 0.5) / (n - t + 0.5)) > 0""")
def grown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each region's customers, grown over all customers, of whom a fifth lack their nation."""
    cells = R.customer(spark, sf_dir).filter("NOT (key = 'nation' AND rec_id % 5 = 0)")
    names = F.broadcast(R.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp")))  # five
    universe = cells.select("rec_id").distinct().crossJoin(names)
    members = cells.filter("key = 'region' AND rec_id % 2 = 0").select(F.col("value").alias("grp"), "rec_id")
    return O.grown(cells, members, universe).select("grp", "rec_id", r6("odds").alias("odds"))


# splits and new nodes


def _regions(spark: SparkSession, sf_dir: str) -> objective.State:
    """Customers, a fifth of them without nation; each region but one is a node."""
    cells = R.customer(spark, sf_dir).filter("NOT (key = 'nation' AND rec_id % 5 = 0)")
    return objective.from_partition(cells, cells.filter("key = 'region' AND value <> 'AFRICA'").select("rec_id", F.col("value").alias("label")))


_REGIONS = f"""cells AS MATERIALIZED ({_GAPPY}), m0 AS (SELECT value AS node, rec_id FROM cells WHERE key = 'region' AND value <> 'AFRICA'), su0 AS (SELECT DISTINCT node, key FROM m0 JOIN cells USING (rec_id)),
tot AS (SELECT count(DISTINCT rec_id) AS n, count(DISTINCT key) AS a FROM cells), inv AS (SELECT key, count(DISTINCT value) AS inv, count(*) AS p FROM cells GROUP BY key)"""

# parts of the members g (node, rec_id) by a pair or a key, each grown once
_PARTS = """gc AS MATERIALIZED (SELECT node, rec_id, key, value FROM g JOIN cells USING (rec_id)), gt AS (SELECT node, count(*) AS t FROM g GROUP BY 1),
cc AS (SELECT node, key, value, count(*) AS c FROM gc GROUP BY 1, 2, 3), nc AS (SELECT node, key, count(*) AS nc FROM gc GROUP BY 1, 2),
cs AS (SELECT node, key || '=' || value AS part, key, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, key, value) AS k FROM cc JOIN gt USING (node) WHERE c > 1 AND c <= t - {least}) WHERE k <= 64),
ks AS (SELECT node, key AS part, key FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nc DESC, key) AS k FROM nc JOIN gt USING (node) WHERE nc > 1 AND nc <= t - {least} AND {keys}) WHERE k <= 64),
ofr AS (SELECT node, sum(o) AS offered FROM (SELECT node, 1 AS o FROM cs UNION ALL SELECT node, 2 FROM ks) GROUP BY 1),
seed AS (SELECT node, part, rec_id FROM gc JOIN cs USING (node, key, value) UNION ALL SELECT node, part, rec_id FROM gc JOIN ks USING (node, key)),
ca AS (SELECT node, part, key, value, count(*) AS ca FROM seed JOIN gc USING (node, rec_id) GROUP BY 1, 2, 3, 4), na AS (SELECT node, part, key, sum(ca) AS na FROM ca GROUP BY 1, 2, 3),
w AS (SELECT p.node, p.part, cc.key, cc.value, log2((coalesce(ca, 0) + 0.5) / (coalesce(na, 0) + 0.5 * inv)) - log2((c - coalesce(ca, 0) + 0.5) / (nc - coalesce(na, 0) + 0.5 * inv)) AS w
    FROM (SELECT DISTINCT node, part FROM seed) p JOIN cc ON cc.node = p.node JOIN nc ON nc.node = p.node AND nc.key = cc.key JOIN inv ON inv.key = cc.key LEFT JOIN ca ON ca.node = p.node AND ca.part = p.part AND ca.key = cc.key AND ca.value = cc.value LEFT JOIN na ON na.node = p.node AND na.part = p.part AND na.key = cc.key),
gr AS (SELECT gc.node, w.part, gc.rec_id FROM gc JOIN w ON w.node = gc.node AND w.key = gc.key AND w.value = gc.value GROUP BY 1, 2, 3 HAVING round(sum(w), 9) >= 0),
parts AS MATERIALIZED (SELECT * FROM gr UNION ALL SELECT node, part || ' raw', rec_id FROM seed WHERE NOT contains(part, '=')),
pp AS (SELECT node, part, count(*) AS size FROM parts GROUP BY 1, 2), ok AS (SELECT pp.* FROM pp JOIN gt USING (node) WHERE size < t),
mv AS (SELECT '' AS mv, NULL AS node, NULL AS part UNION ALL SELECT node || '|' || part, node, part FROM ok)"""

# the total of each mv's state: members m (mv, rec_id, node), supports su (mv, node, key), all supported cells of members owned
_TOTALS = f"""tt AS (SELECT mv, node, count(*) AS t FROM m GROUP BY 1, 2), ow AS MATERIALIZED (SELECT m.mv, m.node, c.rec_id, c.key, c.value FROM m JOIN cells c USING (rec_id) JOIN su ON su.mv = m.mv AND su.node = m.node AND su.key = c.key),
ob AS (SELECT mv, node, key, value, count(*) AS c FROM ow GROUP BY 1, 2, 3, 4), og AS (SELECT mv, node, key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM ob GROUP BY 1, 2, 3),
nv AS (SELECT su.mv, su.node, sum(coalesce({D.vblock('s', 'n', 'u', D.naming('inv'))}, 0) + {D.col('coalesce(n, 0)', 't')}) AS own, count(*) AS size FROM su JOIN inv USING (key) JOIN tt ON tt.mv = su.mv AND tt.node = su.node LEFT JOIN og ON og.mv = su.mv AND og.node = su.node AND og.key = su.key GROUP BY 1, 2),
nt AS (SELECT mv, sum({D.col('t', 'n')} + {D.support('size', 'tot.a')} + own) AS bits, count(*) AS nodes FROM nv JOIN tt USING (mv, node) CROSS JOIN tot GROUP BY mv),
cov AS (SELECT mv, key, count(DISTINCT rec_id) AS covered FROM su JOIN m USING (mv, node) GROUP BY 1, 2), pub AS (SELECT mv, key, count(*) AS pub FROM ow GROUP BY 1, 2),
fb AS (SELECT mv, key, value, count(*) AS c FROM (SELECT mv.mv, rec_id, key, value FROM cells CROSS JOIN mv) ANTI JOIN ow USING (mv, rec_id, key) GROUP BY 1, 2, 3), fg AS (SELECT mv, key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM fb GROUP BY 1, 2),
every AS (SELECT mv.mv, inv.* FROM inv CROSS JOIN mv),
bt AS (SELECT mv, sum(CASE WHEN tot.n - coalesce(covered, 0) > 0 THEN {D.col('least(p - coalesce(pub, 0), tot.n - coalesce(covered, 0))', '(tot.n - coalesce(covered, 0))')} ELSE 0 END + coalesce({D.vblock('fg.s', 'fg.n', 'fg.u', D.naming('inv'))}, 0)) AS bits FROM every LEFT JOIN cov USING (mv, key) LEFT JOIN pub USING (mv, key) LEFT JOIN fg USING (mv, key) CROSS JOIN tot GROUP BY mv),
total AS (SELECT mv, nt.bits + bt.bits + {D.universal('(nodes + 1)')} - CASE WHEN nodes > 1 THEN {D.lg2('nodes + 1')} ELSE 0 END AS bits FROM nt JOIN bt USING (mv)),
dl AS (SELECT mv.node, mv.part, size, round(bits - (SELECT bits FROM total WHERE mv = ''), 5) AS delta, round(log2(offered), 6) AS charge FROM total JOIN mv USING (mv) JOIN ok ON ok.node = mv.node AND ok.part = mv.part JOIN ofr ON ofr.node = mv.node)"""

_SPLIT_STATES = """m AS (SELECT mv.mv, m0.rec_id, CASE WHEN m0.node = mv.node AND p.rec_id IS NULL THEN m0.node || ' rest' ELSE m0.node END AS node FROM m0 CROSS JOIN mv LEFT JOIN parts p ON p.node = mv.node AND p.part = mv.part AND p.rec_id = m0.rec_id),
su AS (SELECT mv.mv, su0.node, key FROM su0 CROSS JOIN mv UNION ALL SELECT mv.mv, su0.node || ' rest', key FROM su0 JOIN mv ON mv.node = su0.node)"""

_MINT_STATES = """m AS (SELECT mv.mv, m0.rec_id, m0.node FROM m0 CROSS JOIN mv UNION ALL SELECT mv.mv, p.rec_id, 'new' FROM mv JOIN parts p ON p.node = mv.node AND p.part = mv.part),
ps AS (SELECT DISTINCT p.node, p.part, c.key FROM parts p JOIN cells c USING (rec_id)),
su AS (SELECT mv.mv, su0.node, key FROM su0 CROSS JOIN mv UNION ALL SELECT mv.mv, 'new', ps.key FROM mv JOIN ps ON ps.node = mv.node AND ps.part = mv.part)"""


@query(f"WITH {_REGIONS}, g AS (SELECT * FROM m0), {_PARTS.format(least=2, keys='true')}, {_SPLIT_STATES}, {_TOTALS} SELECT node, part, size, delta, charge FROM dl")
def split_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every region's customers by pairs and keys, grown, with the change of the total that each split makes."""
    out = splits.split_deltas(_regions(spark, sf_dir), two_means=False)
    return out.select("node", "part", "size", F.round("delta", 5).alias("delta"), r6("charge").alias("charge"))


@query()
def two_means_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two-means runs over the customers' cells find, and what each split changes. Tested against plain loops."""
    s = _regions(spark, sf_dir)
    kinds = saved(splits.types(splits.member_types(s.cells, s.membership, s.owner)))
    a = splits.atoms(kinds)
    return splits.deltas(s, kinds, a, saved(splits.means(kinds, a))).select("node", "part", "size", F.round("delta", 5).alias("delta"))


@query(f"WITH {_REGIONS}, g AS (SELECT DISTINCT 'residual' AS node, rec_id FROM cells WHERE rec_id NOT IN (SELECT rec_id FROM m0)), {_PARTS.format(least=1, keys='false')}, {_MINT_STATES}, {_TOTALS} SELECT part, size, (SELECT count(*) FROM ps WHERE ps.part = dl.part) AS keys, delta, charge FROM dl")
def residual_mint_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nodes out of the customers of no node, by pairs grown once, with the change of the total that each makes."""
    out = splits.residual_mint_deltas(_regions(spark, sf_dir))
    return out.select("part", "size", "keys", F.round("delta", 5).alias("delta"), r6("charge").alias("charge"))


# causal losses


@query(f"""WITH cells AS MATERIALIZED ({_GAPPY}), rc AS (SELECT DISTINCT rec_id FROM cells),
m AS MATERIALIZED (SELECT value AS node, rec_id FROM cells WHERE key = 'region' AND value <> 'AFRICA' UNION ALL SELECT '', rec_id FROM rc),
kf AS (SELECT key, min(rec_id) AS born FROM cells GROUP BY 1), vf AS (SELECT key, value, min(rec_id) AS born FROM cells GROUP BY 1, 2),
g AS MATERIALIZED (SELECT r.rec_id, e.node, count(m.rec_id) AS t FROM rc r CROSS JOIN (SELECT DISTINCT node FROM m) e LEFT JOIN m ON m.node = e.node AND m.rec_id < r.rec_id GROUP BY 1, 2 HAVING count(m.rec_id) > 0 OR e.node = ''),
mc AS MATERIALIZED (SELECT m.node, c.rec_id, c.key, c.value FROM m JOIN cells c ON c.rec_id = m.rec_id),
gk AS (SELECT g.rec_id, g.node, g.t, k.key, c.value FROM g JOIN kf k ON k.born < g.rec_id LEFT JOIN cells c ON c.rec_id = g.rec_id AND c.key = k.key),
nk AS (SELECT gk.rec_id, gk.node, gk.t, gk.key, gk.value, count(mc.rec_id) AS n, count(mc.rec_id) FILTER (WHERE mc.value = gk.value) AS c FROM gk LEFT JOIN mc ON mc.node = gk.node AND mc.key = gk.key AND mc.rec_id < gk.rec_id GROUP BY ALL),
al AS (SELECT nk.*, (SELECT count(*) FROM vf WHERE vf.key = nk.key AND vf.born < nk.rec_id) AS a, EXISTS (SELECT 1 FROM vf WHERE vf.key = nk.key AND vf.value = nk.value AND vf.born < nk.rec_id) AS seen FROM nk),
ex AS (SELECT rec_id, node, t, sum(CASE WHEN value IS NULL THEN -log2(1 - (n + 0.5) / (t + 1)) ELSE -log2((n + 0.5) / (t + 1)) - log2((CASE WHEN seen THEN c ELSE 0 END + 0.5) / (n + (a + 1) / 2.0)) + CASE WHEN seen THEN 0 ELSE {_STRING.format('value')} END END) AS bits FROM al GROUP BY 1, 2, 3),
el AS (SELECT g.rec_id, g.t + 0.5 AS w, coalesce(bits, 0) AS bits, min(coalesce(bits, 0)) OVER (PARTITION BY g.rec_id) AS least FROM g LEFT JOIN ex USING (rec_id, node)),
sp AS (SELECT rc.rec_id, {_GAMMA.format('count(c.key)')} + coalesce(sum({_STRING.format('c.key')} + {_STRING.format('c.value')}), 0) AS s FROM rc LEFT JOIN (SELECT c.* FROM cells c JOIN kf ON kf.key = c.key AND kf.born = c.rec_id) c ON c.rec_id = rc.rec_id GROUP BY 1)
SELECT rec_id, round(any_value(s) + any_value(least) - log2(sum(w * pow(2, least - bits)) / sum(w)), 6) AS bits FROM el JOIN sp USING (rec_id) GROUP BY 1""")
def causal_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer costs on arrival, under regions (but one) and the background as they were before it."""
    cells = R.customer(spark, sf_dir).filter("NOT (key = 'nation' AND rec_id % 5 = 0)")
    members = cells.filter("key = 'region' AND value <> 'AFRICA'").select(F.col("value").alias("node"), "rec_id")
    return predictive.causal_losses(cells, members, chunk=1000).select("rec_id", r6("bits").alias("bits"))


# levels


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, a fifth without nation; regions as parents, their market segments as leaves."""
    cells = R.customer(spark, sf_dir).filter("NOT (key = 'nation' AND rec_id % 5 = 0)")
    of = lambda key, name: cells.filter(F.col("key") == key).select("rec_id", F.col("value").alias(name))
    return cells, of("region", "parent").join(of("segment", "leaf"), "rec_id")


_LEVELS = f"""cells AS MATERIALIZED ({_GAPPY}), lv AS MATERIALIZED (SELECT a.rec_id, a.value AS parent, b.value AS leaf FROM cells a JOIN cells b ON a.rec_id = b.rec_id AND a.key = 'region' AND b.key = 'segment'),
w AS (SELECT count(DISTINCT rec_id) AS n, count(DISTINCT key) AS a FROM cells), inv AS (SELECT key, count(DISTINCT value) AS inv FROM cells GROUP BY 1),
ls AS (SELECT parent, leaf, count(*) AS t FROM lv GROUP BY 1, 2), ps AS (SELECT parent, count(*) AS t FROM lv GROUP BY 1),
lc AS (SELECT parent, leaf, key, value, count(*) AS c FROM lv JOIN cells USING (rec_id) GROUP BY 1, 2, 3, 4), pc AS (SELECT parent, key, value, sum(c) AS c FROM lc GROUP BY 1, 2, 3),
lb AS (SELECT g.parent, g.leaf, g.key, {D.col('p', 't')} AS pr, {D.vblock('s', 'p', 'u', D.naming('inv'))} AS v FROM (SELECT parent, leaf, key, sum(c) AS p, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM lc GROUP BY 1, 2, 3) g JOIN ls USING (parent, leaf) JOIN inv USING (key)),
pb AS (SELECT g.parent, g.key, {D.col('p', 't')} AS pr, {D.vblock('s', 'p', 'u', D.naming('inv'))} AS v FROM (SELECT parent, key, sum(c) AS p, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM pc GROUP BY 1, 2) g JOIN ps USING (parent) JOIN inv USING (key)),
pl AS (SELECT pb.parent, pb.key, pb.pr + pb.v AS at_parent, at_leaves, round(pb.pr + pb.v, 9) <= round(at_leaves, 9) AS kept FROM pb JOIN (SELECT parent, key, sum(pr + v) AS at_leaves FROM lb GROUP BY 1, 2) l USING (parent, key))"""

_SHAPE = f"({D.universal('(count(*) + 1)')} - CASE WHEN count(*) > 1 THEN {D.lg2('count(*) + 1')} ELSE 0 END)"
_SUPPORT = f"(CASE WHEN coalesce(k, 0) = 0 THEN {D.universal('1')} ELSE {D.support('greatest(k, 1)', 'a')} END)"


@query(f"WITH {_LEVELS} SELECT parent, key, round(at_parent, 6) AS at_parent, round(at_leaves, 6) AS at_leaves, kept FROM pl")
def key_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region and key, what it costs written once by the region or by each of its segments."""
    cells, leaves = _segments(spark, sf_dir)
    sizes = leaves.groupBy("parent", "leaf").agg(F.count("*").alias("t"))
    out = levels.placements(saved(levels.counts(cells, leaves)), sizes, objective.inventory(cells))
    return out.select("parent", "key", r6("at_parent").alias("at_parent"), r6("at_leaves").alias("at_leaves"), "kept")


@query(f"""WITH {_LEVELS},
fl AS (SELECT {_SHAPE} + sum({D.col('t', 'n')} + {_SUPPORT} + pr + v) AS flat FROM ls JOIN (SELECT parent, leaf, count(*) AS k, sum(pr) AS pr, sum(v) AS v FROM lb GROUP BY 1, 2) USING (parent, leaf) CROSS JOIN w),
pt AS (SELECT {_SHAPE} + sum({D.col('t', 'n')} + {_SUPPORT} + coalesce(pr, 0) + coalesce(v, 0)) AS parents FROM ps LEFT JOIN (SELECT parent, count(*) AS k, sum(pr) AS pr, sum(v) AS v FROM pb JOIN pl USING (parent, key) WHERE kept GROUP BY 1) USING (parent) CROSS JOIN w),
un AS (SELECT {_SHAPE} + sum({D.col('ls.t', 'ps.t')} + {_SUPPORT} + coalesce(pr, 0) + coalesce(v, 0)) AS leaves, count(*) * log2(count(DISTINCT parent)) AS pointer FROM ls JOIN ps USING (parent) LEFT JOIN (SELECT parent, leaf, count(*) AS k, sum(pr) AS pr, sum(v) AS v FROM lb JOIN pl USING (parent, key) WHERE NOT kept GROUP BY 1, 2) USING (parent, leaf) CROSS JOIN w)
SELECT round(flat, 5) AS flat, round(parents + leaves + pointer, 5) AS nested, round(pointer, 6) AS pointer FROM fl, pt, un""")
def flat_and_nested_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all regions coded as groups of the stream, and as leaves under the regions."""
    return levels.flat_and_nested(*_segments(spark, sf_dir)).select(F.round("flat", 5).alias("flat"), F.round("nested", 5).alias("nested"), r6("pointer").alias("pointer"))


# snapshots


_SNAPSHOTS = f"""cells AS MATERIALIZED ({D.CUSTOMER}), n AS (SELECT count(DISTINCT rec_id) AS n FROM cells),
a AS MATERIALIZED (SELECT value AS node, rec_id FROM cells WHERE key IN ('region', 'segment')),
b AS MATERIALIZED (SELECT CASE WHEN key = 'region' AND value IN ('AFRICA', 'ASIA') THEN 'new A' ELSE 'new ' || value END AS node, rec_id FROM cells WHERE (key = 'region' AND rec_id % 7 <> 0) OR (key = 'segment' AND rec_id % 3 <> 0)),
p AS MATERIALIZED (SELECT a, b, o AS both_n, o / (x.n + y.n - o) AS j FROM (SELECT a.node AS a, b.node AS b, count(*) AS o FROM a JOIN b USING (rec_id) GROUP BY 1, 2) JOIN (SELECT node AS a, count(*) AS n FROM a GROUP BY 1) x USING (a) JOIN (SELECT node AS b, count(*) AS n FROM b GROUP BY 1) y USING (b)),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY both_n DESC, a, b) AS k FROM p),
g(k, ua, ub) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT r.k, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM g JOIN r ON r.k = g.k + 1),
m AS (SELECT r.* FROM r JOIN g x ON x.k = r.k JOIN g y ON y.k = r.k - 1 WHERE len(x.ua) > len(y.ua))"""


def _two_covers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions and segments of customers; and the same with two regions merged and some members gone."""
    cells = R.customer(spark, sf_dir)
    a = cells.filter("key IN ('region', 'segment')").select(F.col("value").alias("node"), "rec_id")
    name = F.when((F.col("key") == "region") & F.col("value").isin("AFRICA", "ASIA"), "new A").otherwise(F.concat(F.lit("new "), "value"))
    b = cells.filter("(key = 'region' AND rec_id % 7 <> 0) OR (key = 'segment' AND rec_id % 3 <> 0)").select(name.alias("node"), "rec_id")
    return a, b


@query(f"WITH RECURSIVE {_SNAPSHOTS} SELECT a, b, both_n, round(j, 6) AS jaccard FROM m")
def matched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two covers that answer to each other."""
    return snapshots.match(snapshots.overlaps(*_two_covers(spark, sf_dir))).select("a", "b", F.col("both").alias("both_n"), r6("jaccard").alias("jaccard"))


@query(f"""WITH RECURSIVE {_SNAPSHOTS}, bn AS (SELECT b.rec_id, coalesce(m.a, 'fresh ' || b.node) AS node FROM b LEFT JOIN m ON m.b = b.node),
ch AS (SELECT count(*) AS changed FROM (SELECT rec_id FROM (SELECT rec_id, list_sort(list(node)) AS s FROM a GROUP BY 1) x FULL JOIN (SELECT rec_id, list_sort(list(node)) AS s FROM bn GROUP BY 1) y USING (rec_id) WHERE x.s IS DISTINCT FROM y.s)),
ba AS (SELECT node, max(coalesce(j, 0)) AS best FROM (SELECT node FROM a GROUP BY 1 HAVING count(*) >= greatest(2, (SELECT round(0.05 * n) FROM n))) LEFT JOIN p ON p.a = node GROUP BY 1),
bb AS (SELECT node, max(coalesce(j, 0)) AS best FROM (SELECT node FROM b GROUP BY 1 HAVING count(*) >= greatest(2, (SELECT round(0.05 * n) FROM n))) LEFT JOIN p ON p.b = node GROUP BY 1)
SELECT (SELECT count(DISTINCT node) FROM a) AS nodes_a, (SELECT count(DISTINCT node) FROM b) AS nodes_b, (SELECT count(*) FROM m) AS matched, round((SELECT avg(j) FROM m), 6) AS mean_jaccard, round((SELECT min(j) FROM m), 6) AS min_jaccard, (SELECT changed FROM ch) AS changed, round((SELECT changed FROM ch) / (SELECT n FROM n), 6) AS changed_share,
(SELECT count(*) FROM ba) AS big_a, (SELECT count(*) FROM ba WHERE best >= 0.5) AS surviving_a, round((SELECT min(best) FROM ba), 6) AS worst_a, (SELECT count(*) FROM bb) AS big_b, (SELECT count(*) FROM bb WHERE best >= 0.5) AS surviving_b, round((SELECT min(best) FROM bb), 6) AS worst_b""")
def snapshot_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two covers of the customers differ."""
    out = snapshots.compare(*_two_covers(spark, sf_dir), R.table(spark, sf_dir, "customer").count())
    return out.withColumns({c: r6(c) for c in ("mean_jaccard", "min_jaccard", "changed_share", "worst_a", "worst_b")})


# the branch code


@query(f"""WITH RECURSIVE {_PLACES}, {_CHEAPEST}, {_DESCRIPTION},
dp(node, depth) AS (SELECT node, 1 FROM t UNION SELECT l.child, depth + 1 FROM dp JOIN links l ON l.parent = dp.node),
rk AS (SELECT node, row_number() OVER (ORDER BY max(depth), node) - 1 AS rank FROM dp GROUP BY node),
mr AS (SELECT c.rec_id, (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.rec_id = c.rec_id AND m.node = rk.node) THEN '1' ELSE '0' END, '' ORDER BY rank) FROM rk) AS marks FROM (SELECT DISTINCT rec_id FROM cells) c),
vo AS MATERIALIZED (SELECT rec_id, row_number() OVER (ORDER BY turn, marks) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY marks ORDER BY rec_id) AS turn FROM mr)),
sl AS (SELECT s.*, pos, count(*) OVER (PARTITION BY node, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tb, count(value) OVER (PARTITION BY node, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
    row_number() OVER (PARTITION BY node, key, value ORDER BY pos) - 1 AS cb FROM slots s JOIN vo USING (rec_id)),
pd AS (SELECT sum(-log2((CASE WHEN value IS NULL THEN tb - nb ELSE nb END + 0.5) / (tb + 1))) AS p, sum(CASE WHEN value IS NULL THEN 0 ELSE -log2((cb + 0.5) / (nb + d / 2)) END) AS v FROM sl JOIN owners o ON o.rec_id = sl.rec_id AND o.key = sl.key AND o.node = sl.node JOIN keys ON keys.key = sl.key),
fm AS (SELECT t.node, coalesce((SELECT string_agg(parent, '|' ORDER BY parent) FROM links WHERE child = t.node), '') AS family FROM t), fk AS (SELECT family, count(*) AS children FROM fm GROUP BY 1),
my AS (SELECT f.family, r.rec_id FROM fk f CROSS JOIN (SELECT DISTINCT rec_id FROM cells) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(f.family, '|')) AS p) x WHERE p <> '' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.node = p AND m.rec_id = r.rec_id))),
pa AS (SELECT family, pattern, count(*) AS c FROM (SELECT my.family, my.rec_id, list_sort(list(m.node) FILTER (WHERE m.node IS NOT NULL)) AS pattern FROM my LEFT JOIN (SELECT fm.family, m.rec_id, m.node FROM members m JOIN fm USING (node)) m ON m.family = my.family AND m.rec_id = my.rec_id GROUP BY 1, 2) GROUP BY 1, 2),
ls2 AS (SELECT family, count(*) AS k, sum({_bin('coalesce(len(pattern), 0)', 'children')}) AS bits, sum(c) AS n, sum({_half('c')}) AS s FROM pa JOIN fk USING (family) GROUP BY 1),
mp AS (SELECT sum({_GAMMA.format('k')} + bits) AS patterns, sum(CASE WHEN k > 1 THEN {D.ktblock('s', 'n', 'k')} ELSE 0 END) AS member FROM ls2)
SELECT round(header + 8, 6) AS header, round(structure, 6) AS structure, round(patterns, 6) AS membership_patterns, round(member, 6) AS membership, round(ownership, 6) AS ownership, round(pd.p + cp.bits, 5) AS presence, round(pd.v + cv.bits, 5) AS values FROM al, mp, pd, cp, cv""")
def branch_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places' hierarchy in the branch code."""
    out = branches.description(O.settled(O.route_cheapest(places(spark, sf_dir, alike=True))), chunk=5000)
    return out.select(*[r6(c).alias(c) for c in ("header", "structure", "membership_patterns", "membership", "ownership")], *[F.round(c, 5).alias(c) for c in ("presence", "values")])


# credit for keys that no member has; summaries of bounded size


@query(f"""WITH cells AS MATERIALIZED ({D.MIXED}), n AS (SELECT count(DISTINCT rec_id) AS n FROM cells), k AS (SELECT key, count(*) AS bp FROM cells GROUP BY 1), s AS (SELECT key AS sk, value AS sv, count(*) AS t FROM cells GROUP BY 1, 2 HAVING count(*) >= 2),
h AS (SELECT DISTINCT a.key AS sk, a.value AS sv, b.key FROM cells a JOIN cells b USING (rec_id)),
x AS (SELECT s.sk, s.sv, s.t, k.key, s.t * {D.kt('(n - bp)', 'n', '2')} - {D.col('0', 's.t')} AS g FROM s CROSS JOIN k CROSS JOIN n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sk = s.sk AND h.sv = s.sv AND h.key = k.key))
SELECT s.sk AS seed_key, s.sv AS seed_value, s.t, count(x.key) AS absent_keys, round(coalesce(sum(g), 0), 5) AS credit FROM s LEFT JOIN x ON x.sk = s.sk AND x.sv = s.sv GROUP BY 1, 2, 3""")
def absence_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every pair's records save on the keys that none of them has."""
    out = accounts.absence_credit(R.mixed(spark, sf_dir).drop("truth"))
    return out.select("seed_key", "seed_value", "t", "absent_keys", F.round("credit", 5).alias("credit"))


@query("""WITH l AS (SELECT l_returnflag AS mode, l_orderkey * 10 + l_linenumber AS line, round(CAST(l_extendedprice AS DOUBLE) / l_quantity, 6) AS ratio FROM lineitem),
r AS (SELECT mode, ratio, row_number() OVER (PARTITION BY mode ORDER BY ratio) AS k, count(*) OVER (PARTITION BY mode) AS c FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY md5(CAST(line AS VARCHAR)), line) AS d FROM l) WHERE d <= 2000)
SELECT mode, count(*) AS n, round(avg(ratio), 6) AS mean, min(ratio) AS least, max(ratio) AS greatest, (SELECT ratio FROM r WHERE r.mode = l.mode AND k = greatest(1, ceil(0.5 * c))) AS p50, (SELECT ratio FROM r WHERE r.mode = l.mode AND k = greatest(1, ceil(0.99 * c))) AS p99 FROM l GROUP BY mode""")
def ratio_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price for each unit of the lines of a return flag: exact figures, and quantiles of a reservoir of 2,000."""
    l = R.table(spark, sf_dir, "lineitem")  # noqa: E741
    ratio = r6(F.col("l_extendedprice").cast("double") / F.col("l_quantity"))
    rows = l.select(F.col("l_returnflag").alias("mode"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), ratio.alias("ratio"))
    return nulls.summaries(rows, ["mode"], "line", "ratio", {"p50": 0.5, "p99": 0.99}, 2000).withColumn("mean", r6("mean"))


# nesting found in a cover


def _nested_cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' cells, and a cover of them: regions, nations (every fourth customer of Asia strays into INDIA) and segments, with supports."""
    cells = saved(R.customer(spark, sf_dir))
    own = cells.select(F.concat_ws(":", "key", "value").alias("node"), "rec_id")
    strays = cells.filter("key = 'region' AND value = 'ASIA' AND rec_id % 4 = 0").select(F.lit("nation:INDIA").alias("node"), "rec_id")
    members = own.unionByName(strays).distinct()
    key = F.explode(F.when(F.col("node").startswith("nation:C"), F.array(F.lit("nation"), F.lit("region"))).otherwise(F.array(F.split("node", ":")[0])))
    return cells, members, members.select("node").distinct().select("node", key.alias("key"))


_NESTED = f"""cells AS MATERIALIZED ({D.CUSTOMER}), mb AS MATERIALIZED (SELECT key || ':' || value AS node, rec_id FROM cells UNION SELECT 'nation:INDIA', rec_id FROM cells WHERE key = 'region' AND value = 'ASIA' AND rec_id % 4 = 0),
sp AS (SELECT node, unnest(CASE WHEN node LIKE 'nation:C%' THEN ['nation', 'region'] ELSE [split_part(node, ':', 1)] END) AS key FROM (SELECT DISTINCT node FROM mb)),
lb AS (SELECT a.rec_id, a.value AS family, b.value AS kind FROM cells a JOIN cells b USING (rec_id) WHERE a.key = 'region' AND b.key = 'nation'),
sz AS (SELECT node, count(*) AS size FROM mb GROUP BY 1),
fp AS (SELECT node, family, c / size AS p FROM (SELECT node, family, count(*) AS c, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, family) AS k FROM mb JOIN lb USING (rec_id) GROUP BY 1, 2) JOIN sz USING (node) WHERE k = 1),
kp AS (SELECT node, kind, c / size AS p FROM (SELECT node, kind, count(*) AS c, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, kind) AS k FROM mb JOIN lb USING (rec_id) GROUP BY 1, 2) JOIN sz USING (node) WHERE k = 1),
pa AS (SELECT fp.node AS parent, family AS parent_label FROM fp JOIN kp USING (node) WHERE fp.p >= 0.8 AND kp.p < 0.6), ch AS (SELECT node AS child, kind AS child_label FROM kp WHERE p >= 0.8),
ed AS (SELECT child, parent, (SELECT count(*) FROM mb a JOIN mb b USING (rec_id) WHERE a.node = child AND b.node = parent) / size AS containment, child_label, parent_label FROM ch CROSS JOIN pa JOIN sz ON sz.node = child
    WHERE NOT EXISTS (SELECT 1 FROM sp x JOIN sp y USING (key) WHERE x.node = child AND y.node = parent))"""


@query(f"WITH {_NESTED} SELECT child, parent, round(containment, 6) AS containment, child_label, parent_label FROM ed WHERE containment >= 0.8")
def nested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that lie in regions, as nodes of a cover, where their supports are disjoint."""
    cells, members, support = _nested_cover(spark, sf_dir)
    label = lambda key: cells.filter(F.col("key") == key).select("rec_id", F.col("value").alias("label"))
    return levels.nested_edges(members, support, label("region"), label("nation")).withColumn("containment", r6("containment"))


@query(f"WITH {_NESTED}, gd AS (SELECT DISTINCT kind AS child_label, family AS parent_label FROM lb), ok AS (SELECT * FROM ed WHERE containment >= 0.8) SELECT count(*) AS found, count(gd.child_label) AS correct, (SELECT count(*) FROM gd) AS planted, round(count(gd.child_label) / count(*), 6) AS precision, round(count(gd.child_label) / (SELECT count(*) FROM gd), 6) AS recall FROM ok LEFT JOIN gd ON gd.child_label = ok.child_label AND gd.parent_label = ok.parent_label")
def nesting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested edges held against what nations and regions say."""
    cells, members, support = _nested_cover(spark, sf_dir)
    label = lambda key, name="label": cells.filter(F.col("key") == key).select("rec_id", F.col("value").alias(name))
    edges = levels.nested_edges(members, support, label("region"), label("nation"))
    gold = label("nation", "child_label").join(label("region", "parent_label"), "rec_id")
    return levels.edge_scores(edges, gold).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(f"WITH {_NESTED} SELECT node, count(*) FILTER (WHERE key = 'region') AS upper, count(*) FILTER (WHERE key <> 'region') AS lower, count(*) FILTER (WHERE key = 'region') > 0 AND count(*) FILTER (WHERE key <> 'region') > 0 AS inlined FROM sp GROUP BY 1")
def inlined_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the cover that write the region's key beside their own."""
    _, _, support = _nested_cover(spark, sf_dir)
    return levels.inlining(support, spark.createDataFrame([("region", True), ("nation", False), ("segment", False)], "key string, upper boolean"))


# nearest rows


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64), d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(pow(list_distance(q.v, e.v), 2), 9) AS distance FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(k AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM d) WHERE k <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 100, exactly."""
    e = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest.nearest(e, e.filter("id % 100 = 0")).withColumn("distance", r6("distance"))
