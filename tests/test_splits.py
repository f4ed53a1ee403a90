"""Split proposals on tables against plain loops over records."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from bitquarry.operators import objective, splits


def stream(seed, n=60):
    """Two kinds of records in each of two groups, some cells missing, some noise."""
    rng = random.Random(seed)
    out = {}
    for r in range(n):
        kind = rng.choice("AB")
        rec = {k: f"{kind}{rng.randint(0, 1)}" if rng.random() < 0.8 else rng.choice(["A0", "B1"]) for k in "pqrs" if rng.random() < 0.85}
        if kind == "A" and rng.random() < 0.5:
            rec["t"] = "x"
        if rec:
            out[r] = (rng.choice(["one", "two"]), rec)
    return out


def state(spark, recs):
    cells = spark.createDataFrame([(r, k, v) for r, (_, rec) in recs.items() for k, v in rec.items()], "rec_id long, key string, value string")
    return objective.from_partition(cells, spark.createDataFrame([(r, g) for r, (g, _) in recs.items()], "rec_id long, label string"), 0.3)


def binary_runs(cells, restarts=2):
    """cells: record to its set of pairs. Lloyd on sets from furthest-point starts."""
    apart = lambda a, b: len(a ^ b)
    picks = [max(cells, key=lambda r: (len(cells[r]), -r))]
    while len(picks) < 2 * restarts:
        far = max(cells, key=lambda r: (min(apart(cells[r], cells[p]) for p in picks), -r))
        if min(apart(cells[far], cells[p]) for p in picks) == 0:
            break
        picks.append(far)
    out = {}
    for i in range(len(picks) // 2):
        a, b, kept = cells[picks[2 * i]], cells[picks[2 * i + 1]], None
        for _ in range(12):
            now = {r for r in cells if apart(cells[r], a) <= apart(cells[r], b)}
            if not now or len(now) == len(cells) or now == kept:
                break
            kept = now
            common = lambda rs: frozenset(c for c, k in Counter(c for r in rs for c in cells[r]).items() if 2 * k >= len(rs))
            a, b = common(now), common(set(cells) - now)
        if kept:
            out[f"binary {i}"] = kept
    return out


def cosine_run(cells):
    def like(r, profile):
        norm = math.sqrt(sum(x * x for x in profile.values()))
        return round(sum(profile.get(c, 0.0) for c in cells[r]) / math.sqrt(len(cells[r])) / norm, 12) if norm else 0.0

    mean = lambda rs: {c: k / len(rs) for c, k in Counter(c for r in rs for c in cells[r]).items()}
    whole = mean(cells)
    a = min(cells, key=lambda r: (round(like(r, whole), 9), r))
    b = min(cells, key=lambda r: (round(like(r, mean([a])), 9), r))
    sides = ({a}, {b})
    for _ in range(10):
        pa, pb = mean(sides[0]), mean(sides[1])
        scale = lambda p: {c: x / math.sqrt(sum(y * y for y in p.values())) for c, x in p.items()}
        sa, sb = scale(pa), scale(pb)
        inside = {r for r in cells if round(sum(sa.get(c, 0) for c in cells[r]), 10) >= round(sum(sb.get(c, 0) for c in cells[r]), 10)}
        if not inside or len(inside) == len(cells):
            return None
        if inside == sides[0]:
            return inside
        sides = (inside, set(cells) - inside)
    return sides[0]


def test_two_means_parts_equal_plain_loops(spark):
    recs = stream(4)
    s = state(spark, recs)
    typed = splits.member_types(s.cells, s.membership, s.owner)
    kinds = splits.types(typed)
    found = splits.means(kinds, splits.atoms(kinds), 2).join(typed.select("node", "type", "rec_id"), ["node", "type"])
    got = {}
    for r in found.collect():
        got.setdefault((r.node, r.part), set()).add(r.rec_id)
    want = {}
    for g in ("one", "two"):
        cells = {r: frozenset(rec.items()) for r, (h, rec) in recs.items() if h == g}
        want |= {(g, k): v for k, v in binary_runs(cells).items()}
        if run := cosine_run(cells):
            want[g, "two-means"] = run
    assert got == want and len(want) > 2


def test_each_delta_is_the_change_of_the_total(spark):
    s = state(spark, stream(2))
    before = objective.total(s).first().total
    parts, offered, kinds, typed = splits.proposals(s)
    priced = splits.deltas(s, kinds, splits.atoms(kinds), parts).orderBy("node", "part").collect()
    assert len(priced) > 10
    for row in random.Random(3).sample(priced, 2):
        inside = typed.join(parts.filter((F.col("node") == row.node) & (F.col("part") == row.part)), ["node", "type"]).select("node", "rec_id")
        assert inside.count() == row["size"]
        move = lambda df: df.join(inside.withColumn("in", F.lit(True)), ["node", "rec_id"], "left").withColumn("node", F.when((F.col("node") == row.node) & F.col("in").isNull(), F.concat("node", F.lit(" rest"))).otherwise(F.col("node"))).drop("in")
        more = s.support.filter(F.col("node") == row.node).select(F.concat("node", F.lit(" rest")).alias("node"), "key")
        after = objective.State(s.cells, move(s.membership), s.support.unionByName(more), move(s.owner))
        assert objective.audit(after).count() == 0
        assert math.isclose(objective.total(after).first().total - before, row.delta, abs_tol=1e-5)


def test_best_splits_lower_the_total(spark):
    recs = {r: ("all", {"a": f"{g}1", "b": f"{g}2", "c": f"{g}3"}) for r in range(60) for g in "xy"[r % 2]}
    s = state(spark, recs)
    after = splits.split_best(s)
    assert {frozenset(r.rec_id for r in rows) for rows in _by_node(after)} == {frozenset(range(0, 60, 2)), frozenset(range(1, 60, 2))}
    assert objective.total(after).first().total < objective.total(s).first().total


def _by_node(s):
    out = {}
    for r in s.membership.collect():
        out.setdefault(r.node, []).append(r)
    return out.values()


def test_small_nodes_and_an_empty_residual(spark):
    recs = {0: ("one", {"a": "x"}), 1: ("one", {"a": "y"}), 2: ("two", {"a": "x"})}
    s = state(spark, recs)
    assert splits.split_deltas(s).count() == 0
    assert splits.residual_mint_deltas(s).count() == 0
