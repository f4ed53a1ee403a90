"""A hierarchy of groups: a DAG of nodes, its description in bits, moves, greedy repair, and a lossless snapshot.

A node has members, a support of keys and parents; members of a child are
members of each parent. A slot (record, key) is owned by one node that has the
record and supports the key, or by the background; absent slots are owned too.
States are small beside the records they describe, so they are plain objects;
many states (streams, orders, fixtures) are rows of a DataFrame (``learn``).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from bitquarry.operators.codec import CodecError, Reader, Writer

MAGIC = b"BQH1"


@dataclass
class Group:
    members: frozenset[int]
    support: frozenset[str]
    parents: frozenset[int] = frozenset()


@dataclass
class Hierarchy:
    records: list[dict[str, str]]
    groups: dict[int, Group] = field(default_factory=dict)

    def keys(self) -> list[str]:
        return sorted({k for r in self.records for k in r})

    def ancestors(self, node: int) -> set[int]:
        out: set[int] = set()
        todo = list(self.groups[node].parents)
        while todo:
            p = todo.pop()
            if p not in out:
                out.add(p)
                todo += self.groups[p].parents
        return out

    def validate(self) -> None:
        for v, g in self.groups.items():
            up = self.ancestors(v)
            if not g.members or not g.members <= set(range(len(self.records))):
                raise ValueError("members are rows, one at least")
            if v in up:
                raise ValueError("a cycle")
            for p in g.parents:
                if not g.members <= self.groups[p].members:
                    raise ValueError("a child's members are its parents'")
                if any(p in self.ancestors(q) for q in g.parents if q != p):
                    raise ValueError("a transitive link")

    def order(self) -> list[int]:
        """Parents first; then by support, members."""
        done: list[int] = []
        left = dict(self.groups)
        while left:
            ready = sorted((v for v, g in left.items() if not g.parents - set(done)), key=lambda v: (sorted(left[v].support), sorted(left[v].members), v))
            if not ready:
                raise ValueError("a cycle")
            done.append(ready[0])
            del left[ready[0]]
        return done

    def owners(self) -> dict[tuple[int, str], int]:
        """Each slot's owner: of the nodes that may, the smallest, then the lowest; 0 is the background."""
        out = {}
        for v in sorted(self.groups, key=lambda v: (-len(self.groups[v].members), -v)):
            for m in self.groups[v].members:
                for k in self.groups[v].support:
                    out[m, k] = v
        return out

    def canonical(self) -> tuple:
        at = {v: i for i, v in enumerate(self.order(), 1)}
        return tuple((tuple(sorted(self.groups[v].members)), tuple(sorted(self.groups[v].support)), tuple(sorted(at[p] for p in self.groups[v].parents))) for v in self.order())


def _lg2(x: float) -> float:
    return math.lgamma(x) / math.log(2)


def integer_bits(n: int) -> float:
    return 2 * (n + 1).bit_length() - 1


def kt_bits(counts: list[int]) -> float:
    """A sequence with these symbol counts under adaptive KT frequencies."""
    d, n = len(counts), sum(counts)
    return 0.0 if d <= 1 else _lg2(n + d / 2) - _lg2(d / 2) + sum(_lg2(0.5) - _lg2(c + 0.5) for c in counts)


def description(h: Hierarchy) -> dict[str, float]:
    """Bits of header, structure, membership, presence, values, and their sum."""
    keys = h.keys()
    values = {k: sorted({r[k] for r in h.records if k in r}) for k in keys}
    text = lambda s: integer_bits(len(s.encode())) + 8 * len(s.encode())
    out = {"header": float(integer_bits(len(h.records)) + integer_bits(len(keys)) + sum(text(k) + integer_bits(len(v)) + sum(map(text, v)) for k, v in values.items()))}
    order = h.order()
    structure, membership = float(integer_bits(len(order))), 0.0
    for i, v in enumerate(order):
        g = h.groups[v]
        structure += kt_bits([len(g.parents), i - len(g.parents)]) + kt_bits([len(g.support), len(keys) - len(g.support)])
        rows = set(range(len(h.records))).intersection(*(h.groups[p].members for p in g.parents))
        membership += kt_bits([len(g.members), len(rows) - len(g.members)])
    owner = h.owners()
    present: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
    counts: dict[tuple[int, str], Counter] = defaultdict(Counter)
    for m, r in enumerate(h.records):
        for k in keys:
            o = owner.get((m, k), 0)
            present[o, k][k in r] += 1
            if k in r:
                counts[o, k][r[k]] += 1
    out |= {"structure": structure, "membership": membership}
    out["presence"] = sum(kt_bits(p) for p in present.values())
    out["values"] = sum(kt_bits([c.get(x, 0) for x in values[k]]) for (_, k), c in counts.items())
    return out | {"total": sum(out.values())}


def encode(h: Hierarchy) -> bytes:
    """Records and hierarchy as bytes; about as long as the description."""
    w, keys = Writer(), h.keys()
    values = {k: sorted({r[k] for r in h.records if k in r}) for k in keys}
    w.integer(len(h.records))
    w.integer(len(keys))
    for k in keys:
        w.string(k)
        w.integer(len(values[k]))
        for x in values[k]:
            w.string(x)
    order = h.order()
    w.integer(len(order))
    for i, v in enumerate(order):
        g, links, sup, mem = h.groups[v], [0, 0], [0, 0], [0, 0]
        for p in order[:i]:
            w.symbol(int(p in g.parents), links)
        for k in keys:
            w.symbol(int(k in g.support), sup)
        for m in sorted(set(range(len(h.records))).intersection(*(h.groups[p].members for p in g.parents))):
            w.symbol(int(m in g.members), mem)
    owner = Hierarchy(h.records, {i + 1: Group(h.groups[v].members, h.groups[v].support) for i, v in enumerate(order)}).owners()
    present: dict = defaultdict(lambda: [0, 0])
    counts: dict = {}
    for m, r in enumerate(h.records):
        for k in keys:
            o = owner.get((m, k), 0)
            w.symbol(int(k in r), present[o, k])
            if k in r and len(values[k]) > 1:
                w.symbol(values[k].index(r[k]), counts.setdefault((o, k), [0] * len(values[k])))
    return w.close(MAGIC)


def decode(data: bytes) -> Hierarchy:
    r = Reader(data, MAGIC)
    try:
        n, keys, values = r.integer(), [], {}
        for _ in range(r.integer()):
            k = r.string()
            keys.append(k)
            values[k] = [r.string() for _ in range(r.integer())]
        groups: dict[int, Group] = {}
        for i in range(1, r.integer() + 1):
            links, sup, mem = [0, 0], [0, 0], [0, 0]
            parents = frozenset(p for p in range(1, i) if r.symbol(links))
            support = frozenset(k for k in keys if r.symbol(sup))
            rows = sorted(set(range(n)).intersection(*(groups[p].members for p in parents)))
            groups[i] = Group(frozenset(m for m in rows if r.symbol(mem)), support, parents)
        h = Hierarchy([{} for _ in range(n)], groups)
        owner = h.owners()
        present: dict = defaultdict(lambda: [0, 0])
        counts: dict = {}
        for m in range(n):
            for k in keys:
                o = owner.get((m, k), 0)
                if r.symbol(present[o, k]):
                    h.records[m][k] = values[k][r.symbol(counts.setdefault((o, k), [0] * len(values[k])))] if len(values[k]) > 1 else values[k][0]
        return h
    except (IndexError, KeyError, UnicodeDecodeError) as e:
        raise CodecError("broken") from e


def _with(h: Hierarchy, groups: dict[int, Group]) -> Hierarchy:
    return Hierarchy(h.records, groups)


def create(h: Hierarchy, members: frozenset[int], support: frozenset[str], parents: frozenset[int] = frozenset()) -> Hierarchy:
    return _with(h, h.groups | {max(h.groups, default=0) + 1: Group(members, support, parents)})


def delete(h: Hierarchy, v: int) -> Hierarchy:
    """Children take the node's parents over."""
    gone = h.groups[v]
    rest = {u: Group(g.members, g.support, (g.parents - {v}) | (gone.parents if v in g.parents else frozenset())) for u, g in h.groups.items() if u != v}
    return reduce_links(_with(h, rest))


def add_link(h: Hierarchy, child: int, parent: int) -> Hierarchy:
    """The parent and its ancestors take the child's members in."""
    up = {parent} | h.ancestors(parent)
    groups = {u: Group(g.members | h.groups[child].members if u in up else g.members, g.support, g.parents | {parent} if u == child else g.parents) for u, g in h.groups.items()}
    return reduce_links(_with(h, groups))


def remove_link(h: Hierarchy, child: int, parent: int) -> Hierarchy:
    g = h.groups[child]
    return _with(h, h.groups | {child: Group(g.members, g.support, g.parents - {parent})})


def merge(h: Hierarchy, a: int, b: int) -> Hierarchy:
    x, y = h.groups[a], h.groups[b]
    parents = (x.parents & y.parents) - {a, b}
    joined = Group(x.members | y.members, x.support | y.support, parents)
    rest = {u: Group(g.members, g.support, frozenset(a if p == b else p for p in g.parents)) for u, g in h.groups.items() if u not in (a, b)}
    return reduce_links(_with(h, rest | {a: joined}))


def set_members(h: Hierarchy, v: int, members: frozenset[int]) -> Hierarchy:
    g = h.groups[v]
    return _with(h, h.groups | {v: Group(members, g.support, g.parents)})


def set_support(h: Hierarchy, v: int, support: frozenset[str]) -> Hierarchy:
    g = h.groups[v]
    return _with(h, h.groups | {v: Group(g.members, support, g.parents)})


def reduce_links(h: Hierarchy) -> Hierarchy:
    """Without links that others imply."""
    groups = {v: Group(g.members, g.support, frozenset(p for p in g.parents if not any(p in h.ancestors(q) for q in g.parents if q != p))) for v, g in h.groups.items()}
    return _with(h, groups)


def useful_keys(h: Hierarchy, members: frozenset[int]) -> frozenset[str]:
    """Keys whose slots cost less apart from the rest than together with it."""
    out = []
    for k in h.keys():
        inside, outside = [[0, 0], Counter()], [[0, 0], Counter()]
        alphabet = sorted({r[k] for r in h.records if k in r})
        for m, r in enumerate(h.records):
            side = inside if m in members else outside
            side[0][k in r] += 1
            if k in r:
                side[1][r[k]] += 1
        cost = lambda p, c: kt_bits(p) + kt_bits([c.get(x, 0) for x in alphabet])
        together = cost([a + b for a, b in zip(inside[0], outside[0])], inside[1] + outside[1])
        if cost(*inside) + cost(*outside) < together:
            out.append(k)
    return frozenset(out)


def proposals(h: Hierarchy):
    """Moves of one step: groups of records that share a pair, under each node or none; deletes, merges, links, supports."""
    pairs = defaultdict(set)
    for m, r in enumerate(h.records):
        for kv in r.items():
            pairs[kv].add(m)
    scopes = [(frozenset(), frozenset(range(len(h.records))))] + [(frozenset([v]), g.members) for v, g in h.groups.items()]
    for _, members in sorted(pairs.items()):
        for parents, rows in scopes:
            inside = frozenset(members) & rows
            if 1 < len(inside) < len(rows) and (keys := useful_keys(h, inside)):
                yield "create", create(h, inside, keys, parents)
    for v in sorted(h.groups):
        yield "delete", delete(h, v)
        g = h.groups[v]
        for k in h.keys():
            s = g.support ^ {k}
            if s:
                yield "support", set_support(h, v, s)
        for u in sorted(h.groups):
            if u < v:
                yield "merge", merge(h, u, v)
            if u != v and u not in h.ancestors(v) and v not in h.ancestors(u):
                yield "link", add_link(h, v, u)
        for p in sorted(g.parents):
            yield "unlink", remove_link(h, v, p)


def repair(h: Hierarchy, most: int = 40) -> tuple[Hierarchy, list[dict]]:
    """The best proposal at a time while the description and the snapshot both shrink; a tie of different states is refused."""
    events: list[dict] = []
    now = description(h)["total"]
    for _ in range(most):
        best, name, ties, seen = now - 1e-9, "", set(), set()
        chosen = h
        for what, s in proposals(h):
            sign = s.canonical()
            if sign in seen:
                continue
            seen.add(sign)
            bits = description(s)["total"]
            if bits < best - 1e-9:
                best, name, chosen, ties = bits, what, s, {sign}
            elif name and abs(bits - best) <= 1e-9:
                ties.add(sign)
        if not name or len(encode(chosen)) >= len(encode(h)):
            return h, events
        if len(ties) > 1:
            events.append({"move": "tie", "states": len(ties), "bits": best})
            return h, events
        events.append({"move": name, "bits": best, "saved": now - best})
        h, now = chosen, best
    return h, events


def learn(records: DataFrame, by: str = "stream") -> DataFrame:
    """(by, rec_id, rec) to one row for each stream: records, nodes, bits, bytes, snapshot, round_trip."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r) for _, r in sorted(zip(pdf["rec_id"], pdf["rec"]), key=lambda x: x[0])]
        h, _ = repair(Hierarchy(rows))
        data = encode(h)
        back = decode(data)
        same = back.records == rows and back.canonical() == h.canonical()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "records": [len(rows)], "nodes": [len(h.groups)], "bits": [description(h)["total"]], "bytes": [len(data)], "snapshot": [data], "round_trip": [same]})

    kind = records.schema[by].dataType.simpleString()
    return records.select(by, "rec_id", "rec").groupBy(by).applyInPandas(run, f"{by} {kind}, records bigint, nodes bigint, bits double, bytes bigint, snapshot binary, round_trip boolean")
