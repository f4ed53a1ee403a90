"""Causal losses, matching of covers and the branch code's order and patterns against plain Python."""

import math
import random
from collections import Counter, defaultdict, deque
from dataclasses import replace

import pytest

from bitquarry.operators import branches, predictive, snapshots
from bitquarry.operators import ownership as O
from tests.test_ownership import frames, random_state, rows


def gamma(x):
    return 2 * int(math.log2(x + 1)) + 1


def word(s):
    return 8 * len(s.encode()) + gamma(len(s.encode()))


def probabilities(held, alphabet):
    """Of the known values, and of a value never seen."""
    total = sum(held.values()) + (len(alphabet) + 1) / 2
    return {v: (held[v] + 0.5) / total for v in alphabet}, 0.5 / total


def plain_loss(past, groups, rec):
    known = {k for r in past.values() for k in r}
    common = gamma(len(rec.keys() - known)) + sum(word(k) + word(rec[k]) for k in rec.keys() - known)
    experts = [set(past)] + [g & past.keys() for g in groups.values() if g & past.keys()]
    losses = []
    for g in experts:
        bits = 0.0
        for k in known:
            held = Counter(past[r][k] for r in g if k in past[r])
            alphabet = {r[k] for r in past.values() if k in r}
            p, escape = probabilities(held, alphabet)
            assert math.isclose(sum(p.values()) + escape, 1.0)
            there = (sum(held.values()) + 0.5) / (len(g) + 1)
            bits -= math.log2(there if k in rec else 1 - there)
            if k in rec:
                bits += -math.log2(p[rec[k]]) if rec[k] in p else word(rec[k]) - math.log2(escape)
        losses.append((len(g) + 0.5, bits))
    least = min(b for _, b in losses)
    return common + least - math.log2(sum(w * 2 ** (least - b) for w, b in losses) / sum(w for w, _ in losses))


def test_causal_losses_equal_a_walk_through_the_stream(spark):
    rng = random.Random(7)
    records = {r * 3: {k: rng.choice("uvwé") for k in ("a", "bb", "ç")[: 1 + r // 6] if rng.random() < 0.7} for r in range(24)}
    records = {r: rec for r, rec in records.items() if rec}
    groups = {g: {r for r in records if rng.random() < 0.4} for g in ("x", "y")}
    cells = spark.createDataFrame([(r, k, v) for r, rec in records.items() for k, v in rec.items()], "rec_id long, key string, value string")
    members = spark.createDataFrame([(g, r) for g, rs in groups.items() for r in rs], "node string, rec_id long")
    got = {r.rec_id: r.bits for r in predictive.causal_losses(cells, members, chunk=10).collect()}
    assert got.keys() == records.keys()
    for r, rec in records.items():
        assert math.isclose(got[r], plain_loss({q: x for q, x in records.items() if q < r}, groups, rec), abs_tol=1e-6), r


def test_rounds_of_best_matches_equal_one_walk_down_the_sorted_pairs(spark):
    rng = random.Random(8)
    pairs = [(f"a{i}", f"b{j}", rng.randint(1, 6)) for i in range(14) for j in range(12) if rng.random() < 0.4]
    want, used = set(), set()
    for _, a, b in sorted((-n, a, b) for a, b, n in pairs):
        if not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    df = spark.createDataFrame([(a, b, n, 0.5) for a, b, n in pairs], "a string, b string, both long, jaccard double")
    assert rows(snapshots.match(df).select("a", "b")) == want
    assert snapshots.match(df.limit(0)).count() == 0


def test_visits_take_turns_and_families_count_patterns(spark):
    records, members, support, _ = random_state(5)
    links = {("n3", "n0"), ("n4", "n0"), ("n5", "n1")}
    members |= {"n3": members["n0"] & members["n3"], "n4": set(list(members["n0"])[:3]), "n5": set(list(members["n1"])[:2]), "n0": members["n0"] | members["n3"]}
    members["n3"] = members["n3"] or {min(members["n0"])}
    h = frames(spark, records, members, support, links)
    order = ["n0", "n1", "n2", "n3", "n4", "n5"]  # by depth, then name
    kinds = defaultdict(list)
    for r in sorted(records):
        kinds[tuple(r in members[v] for v in order)].append(r)
    turns, want = deque(deque(kinds[k]) for k in sorted(kinds)), []
    while turns:
        now = turns.popleft()
        want.append(now.popleft())
        if now:
            turns.append(now)
    got = [r.rec_id for r in branches.visits(h, chunk=7).orderBy("at").collect()]
    assert got == want
    patterns = {(r.family, tuple(r.pattern)): r.c for r in branches.family_patterns(h).collect()}
    plain = Counter()
    for family, children, may in (("", ["n0", "n1", "n2"], set(records)), ("n0", ["n3", "n4"], members["n0"]), ("n1", ["n5"], members["n1"])):
        plain.update((family, tuple(c for c in children if r in members[c])) for r in may)
    assert patterns == dict(plain)


def test_records_alike_stand_as_one_and_change_no_bit(spark):
    rng = random.Random(11)
    records = {r: {k: f"{k}{rng.randrange(2)}" for k in ("a", "b", "c") if rng.random() < 0.8} or {"a": "a0"} for r in range(1, 241)}
    kind = {r: "odd" if r % 2 else "even" for r in records}
    members = {"odd": {r for r in records if r % 2}, "few": {r for r in records if r % 2 and records[r].get("a") == "a1"}, "b": {r for r in records if records[r].get("b") == "b1"}}
    support = {"odd": {"a", "b"}, "few": {"b", "c"}, "b": {"b", "c", "none"}}
    plain = frames(spark, records, members, support, {("few", "odd")})
    cells, weight, of = O.alike(spark.createDataFrame([(r, k, x, kind[r]) for r, rec in records.items() for k, x in rec.items()], "rec_id long, key string, value string, kind string"), "kind")
    stands = {r.record: r.rec_id for r in of.collect()}
    alike = defaultdict(list)
    for r in records:
        alike[kind[r], tuple(sorted(records[r].items()))].append(r)
    assert stands == {r: min(rs) for rs in alike.values() for r in rs} and len(alike) < 60
    assert {(r.rec_id, r.w) for r in weight.collect()} == {(min(rs), len(rs)) for rs in alike.values()}
    one = replace(plain, cells=cells.drop("kind"), members=plain.members.filter(plain.members["rec_id"].isin(sorted(set(stands.values())))), weight=weight, records=of)
    plain, one = O.settled(O.route_cheapest(plain)), O.settled(O.route_cheapest(one))
    owners = {(r.rec_id, r.key): r.node for r in one.owners.collect()}
    assert owners and {(r.rec_id, r.key): r.node for r in plain.owners.collect()} == {(r, k): v for r, m in stands.items() for (x, k), v in owners.items() if x == m}
    close = lambda a, b: [k for k in a if a[k] != pytest.approx(b[k], abs=1e-6)] + sorted(a.keys() ^ b.keys())
    assert not close(O.description(plain).first().asDict(), O.description(one).first().asDict())
    # along the visits, slot by slot, against plain loops
    at = [r.rec_id for r in branches.visits(plain, chunk=7).orderBy("at").collect()]
    assert at == [r.record for r in branches.visits(one, chunk=7).orderBy("at").collect()]
    d = {k: len({rec[k] for rec in records.values() if k in rec}) for k in ("a", "b", "c")}
    t, n, c, want = Counter(), Counter(), Counter(), {}
    owner = {(r.rec_id, r.key): r.node for r in plain.owners.collect()}
    for r in at:
        for v in members:
            if r in members[v]:
                for k in support[v]:
                    x = records[r].get(k)
                    if owner.get((r, k)) == v:
                        seen = n[v, k] if x else t[v] - n[v, k]
                        want[r, v, k] = (-math.log2((seen + 0.5) / (t[v] + 1)), -math.log2((c[v, k, x] + 0.5) / (n[v, k] + d[k] / 2)) if x else 0.0)
                    if x:
                        n[v, k] += 1
                        c[v, k, x] += 1
                t[v] += 1
    for h in (plain, one):
        got = {(r.rec_id, r.node, r.key): (r.presence, r["values"]) for r in branches.predicted(h, branches.visits(h, 7), 7).collect()}
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)
    assert not close(branches.description(plain, 7).first().asDict(), branches.description(one, 7).first().asDict())
