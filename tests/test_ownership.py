"""The hierarchy's tables against plain Python on small random states."""

import math
import random
from collections import Counter, defaultdict

import pytest

from bitquarry.operators import ownership as O


def random_state(seed):
    """Records, members, supports, links and some owners; members are closed under links."""
    rng = random.Random(seed)
    records = {r: {k: rng.choice("xyz") for k in "abcd" if rng.random() < 0.6} for r in range(25)}
    records = {r: rec for r, rec in records.items() if rec}
    nodes = [f"n{i}" for i in range(6)]
    links = {(nodes[j], nodes[i]) for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.35}
    members = {v: set(rng.sample(sorted(records), rng.randint(1, 8))) for v in nodes}
    support = {v: set(rng.sample("abcd", rng.randint(1, 3))) for v in nodes}
    return records, members, support, links


def paths(links, v):
    out, todo = set(), [p for c, p in links if c == v]
    while todo:
        p = todo.pop()
        if p not in out:
            out.add(p)
            todo += [q for c, q in links if c == p]
    return out


def frames(spark, records, members, support, links, owners=()):
    return O.Owned(
        spark.createDataFrame([(r, k, x) for r, rec in records.items() for k, x in rec.items()], "rec_id long, key string, value string"),
        spark.createDataFrame([(v, r) for v, rs in members.items() for r in rs], "node string, rec_id long"),
        spark.createDataFrame([(v, k) for v, ks in support.items() for k in ks], "node string, key string"),
        spark.createDataFrame(sorted(links), "child string, parent string"),
        spark.createDataFrame(list(owners), "rec_id long, key string, node string"),
    )


def rows(df):
    return {tuple(r) for r in df.collect()}


def kt(counts):
    d, n, g = len(counts), sum(counts), lambda x: math.lgamma(x) / math.log(2)
    return 0.0 if d < 2 else g(n + d / 2) - g(d / 2) + sum(g(0.5) - g(c + 0.5) for c in counts)


def plain_description(records, members, support, links, owners):
    gamma = lambda x: 2 * int(math.log2(x + 1)) + 1
    word = lambda s: 8 * len(s.encode()) + gamma(len(s.encode()))
    keys = sorted({k for rec in records.values() for k in rec})
    hist = {k: Counter(rec[k] for rec in records.values() if k in rec) for k in keys}
    n, out = len(records), defaultdict(float)
    out["header"] = 360 + gamma(n) + gamma(len(keys)) + sum(word(k) + gamma(len(h)) + sum(word(v) + gamma(c) for v, c in h.items()) for k, h in hist.items())
    count = len(members)
    most = count * (count - 1) // 2
    out["structure"] = gamma(count) + kt([len(links), most - len(links)]) + sum(kt([len(s), len(keys) - len(s)]) for s in support.values())
    for v, rs in members.items():
        room = set(records).intersection(*(members[p] for c, p in links if c == v))
        out["membership"] += kt([len(rs), len(room) - len(rs)])
    for k in keys:
        routes = defaultdict(Counter)
        blocks = defaultdict(list)
        for r, rec in records.items():
            may = tuple(sorted(v for v in members if r in members[v] and k in support[v]))
            o = owners.get((r, k))
            routes[may][o] += 1
            blocks[o].append(rec.get(k))
        out["ownership"] += sum(kt([c[o] for o in (None, *may)]) for may, c in routes.items())
        for o, held in blocks.items():
            c = Counter(x for x in held if x is not None)
            there, gone = sum(c.values()), held.count(None)
            if o is None:
                p, total = (sum(hist[k].values()) + 0.5) / (n + 1), sum(hist[k].values())
                out["presence"] -= there * math.log2(p) + gone * math.log2(1 - p)
                out["values"] -= sum(m * math.log2((hist[k][x] + 0.5) / (total + len(hist[k]) / 2)) for x, m in c.items())
            else:
                out["presence"] += kt([there, gone])
                out["values"] += kt([c[x] for x in hist[k]])
    return dict(out)


@pytest.mark.parametrize("seed", [1])
def test_closure_reduction_routing_and_description(spark, seed):
    records, members, support, links = random_state(seed)
    h = frames(spark, records, members, support, links)
    up = O.ancestors(h.links)
    assert rows(up) == {(v, p) for v in members for p in paths(links, v)}
    h = O.reduce_links(O.close_members(h, up), up)
    closed = {v: set().union(members[v], *(members[u] for u in members if v in paths(links, u))) for v in members}
    direct = {(c, p) for c, p in links if not any(p in paths(links, q) for d, q in links if d == c and q != p)}
    assert rows(h.members.select("node", "rec_id")) == {(v, r) for v, rs in closed.items() for r in rs}
    assert rows(h.links.select("child", "parent")) == direct
    depth = lambda v: 1 + max((depth(p) for c, p in direct if c == v), default=0)
    assert rows(O.depths(h.links, h.members.select("node").distinct()).select("node", "depth")) == {(v, depth(v)) for v in closed}

    # some slots to their most specific node, some to the background
    h = O.route_specific(h)
    want = {(r, k): min((v for v in closed if r in closed[v] and k in support[v]), key=lambda v: (len(closed[v]), v)) for r in records for k in "abcd" if any(r in closed[v] and k in support[v] for v in closed)}
    assert rows(h.owners.select("rec_id", "key", "node")) == {(r, k, v) for (r, k), v in want.items()}
    kept = {rk: v for rk, v in want.items() if rk[0] % 3}
    h = O.replace(h, owners=spark.createDataFrame([(r, k, v) for (r, k), v in kept.items()], "rec_id long, key string, node string"))
    assert O.violations(h).count() == 0
    got = O.description(h).first().asDict()
    plain = plain_description(records, closed, support, direct, kept)
    for term, bits in plain.items():
        assert math.isclose(got[term], bits, abs_tol=1e-6), term
    assert math.isclose(got["total"], sum(plain.values()), abs_tol=1e-6)


def test_cheapest_owners_cost_no_more_than_the_background_slot_by_slot(spark):
    records, members, support, _ = random_state(3)
    h = O.route_cheapest(frames(spark, records, members, support, set()))
    n, own = len(records), {(r, k): v for r, k, v in rows(h.owners.select("rec_id", "key", "node"))}
    assert own

    def cost(rs, k, x):
        held = [records[r].get(k) for r in rs]
        there = [y for y in held if y is not None]
        if x is None:
            return -math.log2((len(held) - len(there) + 0.5) / (len(held) + 1))
        kinds = len({rec[k] for rec in records.values() if k in rec})
        return -math.log2((len(there) + 0.5) / (len(held) + 1)) - math.log2((there.count(x) + 0.5) / (len(there) + kinds / 2))

    for r in records:
        for k in "abcd":
            may = sorted((round(cost(members[v], k, records[r].get(k)), 9), len(members[v]), v) for v in members if r in members[v] and k in support[v])
            common = round(cost(records, k, records[r].get(k)), 9)
            assert own.get((r, k)) == (may[0][2] if may and may[0][0] < common else None), (r, k, n)


def test_moves_and_revisions(spark):
    records, members, support, links = random_state(2)
    h = O.close_members(O.reduce_links(frames(spark, records, members, support, links)))
    h = O.route_specific(h)
    named = lambda *vs: spark.createDataFrame([(v,) for v in vs], "node string")
    before = {(r, k): v for r, k, v in rows(h.owners.select("rec_id", "key", "node"))}
    routed = O.route(h, named("n1"))
    assert all(v == "n1" for r, k, v in rows(routed.owners.select("rec_id", "key", "node")) if k in support["n1"] and r in {x for n, x in rows(h.members.select("node", "rec_id")) if n == "n1"})
    after = O.delete(routed, named("n1", "n2"))
    assert O.violations(after).count() == 0
    left = rows(after.links.select("child", "parent"))
    ways = {(v, p) for v in members for p in paths(links, v) if not {v, p} & {"n1", "n2"}}
    assert {(v, p) for v in members for p in paths(left, v)} == ways  # what was above stays above
    got = rows(O.revisions(h, after).select("what", "node", "rec_id", "key", "before", "after"))
    now = {(r, k): v for r, k, v in rows(after.owners.select("rec_id", "key", "node"))}
    assert {(r, k, a, b) for w, _, r, k, a, b in got if w == "owner"} == {(r, k, before.get((r, k)), now.get((r, k))) for r, k in before.keys() | now.keys() if before.get((r, k)) != now.get((r, k))}
    assert {v for w, v, *_ in got if w == "node"} == {"n1", "n2"}
    assert O.revisions(h, h).count() == 0


def test_violations_are_named(spark):
    h = frames(spark, {0: {"a": "x"}, 1: {"a": "y"}, 2: {"b": "x"}}, {"p": {0, 1}, "q": {0, 2}, "r": {0}}, {"p": {"a"}, "q": {"a"}, "r": {"b"}}, {("q", "p"), ("r", "q"), ("r", "p")}, [(0, "a", "p"), (0, "a", "q"), (2, "a", "p")])
    assert sorted((r.what, r.node, r.rec_id, r.key) for r in O.violations(h).collect()) == [
        ("implied link", "r", None, None), ("member outside a parent", "q", 2, None), ("owner may not own", "p", 2, "a"), ("two owners", "p", 0, "a")]
    loop = frames(spark, {0: {"a": "x"}}, {"p": {0}, "q": {0}}, {"p": {"a"}, "q": {"a"}}, {("q", "p"), ("p", "q")})
    assert {r.node for r in O.violations(loop).collect() if r.what == "cycle"} == {"p", "q"}
    with pytest.raises(ValueError):
        O.depths(spark.createDataFrame([("q", "p"), ("p", "q"), ("p", "r")], "child string, parent string"), spark.createDataFrame([("p",), ("q",), ("r",)], "node string"))


def test_description_without_nodes_is_the_background_alone(spark):
    records = {0: {"a": "x"}, 1: {"a": "y", "b": "z"}}
    got = O.description(frames(spark, records, {}, {}, set())).first()
    assert math.isclose(got.total, sum(plain_description(records, {}, {}, set(), {}).values()), abs_tol=1e-9)
    assert got.membership == got.ownership == 0


def test_slots_are_dealt_by_rows_and_owners_found_without_sorting(spark, monkeypatch):
    members = spark.createDataFrame([(node, i) for i in range(40) for node in ("all", "half") if node == "all" or i % 2], "node string, rec_id long")
    support = spark.createDataFrame([("all", "k"), ("all", "m"), ("half", "k")], "node string, key string")
    h = O.Owned(spark.createDataFrame([(i, "k", "v") for i in range(40)], "rec_id long, key string, value string"), members, support, spark.createDataFrame([("half", "all")], "child string, parent string"), spark.createDataFrame([], "rec_id long, key string, node string"))
    monkeypatch.setattr(O.dealt, "__defaults__", (5,))
    assert O.dealt(members) == 12
    routed = O.route_specific(h).owners
    assert {(r.rec_id, r.key): r.node for r in routed.collect()} == {(i, k): "half" if k == "k" and i % 2 else "all" for i in range(40) for k in "km"}
    assert "SortAggregate" not in routed._jdf.queryExecution().executedPlan().toString()
    assert len(O.eligible_owners(h).collect()) == 80
