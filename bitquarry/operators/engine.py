"""The record-exact learner: one pass over records, each decided from what came before it.

Arrival order is the meaning of this operator, so one stream is one task;
streams (seeds, orders, tenants) are groups of a DataFrame and run side by side
(``run``). The scalable form for one large stream is ``streaming.epochs``.

Records that are alike (the same cells, nodes, owners and live accounts) can
stand as one with a weight: every move takes them together. What a repair
walks then grows with the kinds of records and not with the stream.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = 4096


def _lg2(x: float) -> float:
    return math.lgamma(x) / math.log(2)


def _kt(c: float, n: float, d: float) -> float:
    return -math.log2((c + 0.5) / (n + d / 2))


def _column(t: float, n: float) -> float:
    return math.log2(math.pi) + _lg2(n + 1) - _lg2(t + 0.5) - _lg2(n - t + 0.5)


def _universal(k: float) -> float:
    out, v = 1.5165, float(k)
    while (v := math.log2(v)) > 0:
        out += v
    return out


def _support(k: int, a: int) -> float:
    return _universal(k) + _lg2(a + 1) - _lg2(k + 1) - _lg2(a - k + 1)


def price(t: int, size: int, n: int, nodes: int, edits: int, keys: int) -> float:
    """Bits of a new node of t members with a support of ``size`` keys."""
    more = _universal(nodes + 1) - _universal(nodes) if nodes else _universal(1)
    return _kt(edits, n - 1, 2) + 2 + _column(t, n) + _support(size, keys) + more + math.log2(nodes + 1)


class Block:
    """Value counts of one key in one place."""

    __slots__ = ("counts", "n")

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.n = 0

    def cost(self, value: str, naming: float) -> float:
        if not self.n:
            return naming
        c, u = self.counts.get(value, 0), len(self.counts)
        return _kt(self.n - u, self.n, 2) + _kt(c, self.n, u) if c else _kt(u, self.n, 2) + naming

    def add(self, value: str, sign: int = 1) -> None:
        self.n += sign
        self.counts[value] += sign
        if not self.counts[value]:
            del self.counts[value]

    def bits(self, naming: float) -> float:
        """The whole block at once."""
        n, u = self.n, len(self.counts)
        if not n:
            return 0.0
        rest = _lg2(n - u + u / 2) - _lg2(u / 2) + sum(_lg2(0.5) - _lg2(c - 0.5) for c in self.counts.values())
        return _column(u, n) + rest + u * naming


@dataclass
class Node:
    born: int
    t: int = 0
    support: frozenset = frozenset()
    published: Counter = field(default_factory=Counter)
    blocks: dict = field(default_factory=lambda: defaultdict(Block))
    members: set = field(default_factory=set)


@dataclass
class Account:
    t: int = 0
    g: defaultdict = field(default_factory=lambda: defaultdict(float))
    published: Counter = field(default_factory=Counter)
    blocks: dict = field(default_factory=lambda: defaultdict(Block))
    members: dict = field(default_factory=dict)  # in order of arrival, without values

    def total(self) -> float:
        return sum(self.g.values())


class Learner:
    """process(record) decides one record; receipts tell each new node's reasons.

    A record goes by its number; with ``alike``, by the number of the first
    record like it (``place``), and ``weight`` says how many these are. Moves
    of parts that cut through such records then can't be asked for.
    """

    def __init__(self, pool: int = POOL, alike: bool = False):
        self.n = self.edits = self.last = 0
        self.pool = pool
        self.background: dict[str, Block] = {}
        self.published: Counter = Counter()
        self.values: dict[str, set] = {}
        self.first: dict[str, int] = {}
        self.nodes: dict[int, Node] = {}
        self.accounts: dict[tuple[str, str], Account] = {}
        self.alike = alike
        self.place = array("q")
        self.weight: dict[int, int] = {}
        self._known: dict[tuple, int] | None = {}  # records by their state; None: a move has changed states since
        self._known_by: dict[int, tuple] = {}
        self.records: dict[int, dict[str, str]] = {}
        self.owner: dict[tuple[int, str], int] = {}
        self.by_pair: dict[tuple[str, str], set] = defaultdict(set)
        self.by_key: dict[str, set] = defaultdict(set)
        self.receipts: list[dict] = []
        # what repair knows: covers by key, how often nodes, keys and the free records changed, and prices with the state they hold for
        self._covers: dict[str, list] = {}
        self._nodes_changed: Counter = Counter()
        self._keys_changed: Counter = Counter()
        self._free_changed = 0
        self._prices: dict[tuple, tuple] = {}

    def process(self, record: dict[str, str]) -> dict | None:
        self.n += 1
        n, past = self.n, self.n - 1
        naming = {k: math.log2(len(self.values.get(k, ())) + 1) for k in record}
        for k, v in record.items():
            if k not in self.first:
                self.first[k] = n
                self.background[k] = Block()
                self.values[k] = set()
            self.values[k].add(v)
        own_value = {k: self.background[k].cost(v, naming[k]) for k, v in record.items()}
        own_presence = {k: _kt(self.published[k], past, 2) for k in record}
        active, owner = self._join(record, naming, own_value, own_presence)
        touched = self._accrue(record, naming, owner, own_value, own_presence)
        self._update(record, active, owner, touched)
        return self._release(touched)

    def _join(self, record, naming, own_value, own_presence) -> tuple[list[int], dict[str, int]]:
        """Nodes that the record joins, greedily by gain; each cell's owner. Costs are lowered to the owner's in place."""
        past = self.n - 1
        near = set().union(*(self.by_pair.get(kv, set()) for kv in record.items()), *(self.by_key.get(k, set()) for k in record))
        gain: dict[int, dict[str, tuple[float, float]]] = {}
        silence: dict[int, float] = {}
        for v in near:
            node = self.nodes[v]
            cost = {}
            for k in node.support & record.keys():
                block = node.blocks[k]
                cost[k] = (block.cost(record[k], naming[k]), _kt(node.published[k], node.t, 2))
            gain[v] = cost
            silence[v] = sum(_kt(past - self.published[k], past, 2) - _kt(node.t - node.published[k], node.t, 2) for k in node.support - record.keys())
        owner: dict[str, int] = {k: 0 for k in record}
        claims: Counter = Counter()
        active: list[int] = []
        while True:
            best, at = 0.0, None
            for v in sorted(near, key=lambda v: (self.nodes[v].born, v)):
                if v in active:
                    continue
                node = self.nodes[v]
                bits = silence[v] - math.log2((past - node.t + 0.5) / (node.t + 0.5))
                for k, (value, presence) in gain[v].items():
                    bits += max(0.0, own_value[k] + own_presence[k] - value - presence) - math.log2((2 + claims[k]) / (1 + claims[k]))
                if bits > best:
                    best, at = bits, v
            if at is None:
                return active, owner
            active.append(at)
            for k, (value, presence) in gain[at].items():
                claims[k] += 1
                if value + presence < own_value[k] + own_presence[k]:
                    own_value[k], own_presence[k], owner[k] = value, presence, at

    def _accrue(self, record, naming, owner, own_value, own_presence) -> list[tuple[str, str]]:
        """Evidence for the accounts of the record's cells in the background, from statistics before it."""
        past = self.n - 1
        absent = {k: _kt(past - self.published[k], past, 2) for k, f in self.first.items() if k not in record and f < self.n}
        touched = []
        for seed in record.items():
            if owner[seed[0]]:
                continue
            touched.append(seed)
            a = self.accounts.setdefault(seed, Account())
            for k, v in record.items():
                a.g[k] += own_value[k] - a.blocks[k].cost(v, naming[k]) + own_presence[k] - _kt(a.published[k], a.t, 2)
            for k, bits in absent.items():
                a.g[k] += bits - _kt(a.t - a.published[k], a.t, 2)
            for k, v in record.items():
                a.blocks[k].add(v)
                a.published[k] += 1
            a.t += 1
        if len(self.accounts) > self.pool:
            keep = set(touched)
            for seed in sorted((s for s in self.accounts if s not in keep), key=lambda s: (self.accounts[s].total(), s))[: len(self.accounts) - self.pool]:
                self._unlike(self.accounts.pop(seed).members)
        return touched

    def _unlike(self, records) -> None:
        """These are no longer in the state that they were known by."""
        for m in records if self._known is not None else ():
            if self._known.get(self._known_by.get(m)) == m:
                del self._known[self._known_by.pop(m)]

    def _like(self, record, active, owner, touched) -> int | None:
        """A record in the same state as the one that arrives."""
        if not self.alike:
            return None
        if self._known is None:
            inside, held = defaultdict(list), defaultdict(list)
            for v, node in self.nodes.items():
                for m in node.members:
                    inside[m].append(v)
            for seed, a in self.accounts.items():
                for m in a.members:
                    held[m].append(seed)
            self._known, self._known_by = {}, {}
            for m, r in self.records.items():
                self._know(self._state(r, inside[m], [self.owner[m, k] for k in r], held[m]), m)
        return self._know(self._state(record, active, owner.values(), touched), self.n)

    def _know(self, state: tuple, m: int) -> int:
        first = self._known.setdefault(state, m)
        if first == m:
            self._known_by[m] = state
        return first

    @staticmethod
    def _state(record, nodes, owners, seeds) -> tuple:
        return tuple(record.items()), frozenset(nodes), tuple(owners), frozenset(seeds)

    def _update(self, record, active, owner, touched) -> None:
        n = self._like(record, active, owner, touched) or self.n
        self.place.append(n)
        new = n == self.n
        if new:
            self.records[n], self.weight[n] = dict(record), 1
            for seed in touched:
                self.accounts[seed].members[n] = None
        else:
            self.weight[n] += 1
            for k in frozenset().union(*(self.nodes[v].support for v in active)):
                if (c := self._covers.get(k)) is not None:
                    c[1] += 1
                    c[2] += k in record
        for v in active:
            node = self.nodes[v]
            node.t += 1
            for k in node.support & record.keys():
                node.published[k] += 1
            if new:
                node.members.add(n)
                for k in node.support:
                    self._cover_one(k, n)
        for k, value in record.items():
            self.published[k] += 1
            if new:
                self.owner[n, k] = owner[k]
            if owner[k]:
                self.nodes[owner[k]].blocks[k].add(value)
                self.by_pair[k, value].add(owner[k])
            else:
                self.background[k].add(value)

    def _release(self, touched) -> dict | None:
        """The touched account that pays best, if any pays."""
        best = None
        for seed in touched:
            a = self.accounts[seed]
            if a.t < 2:
                continue
            outside = sum(g for k, g in a.g.items() if g > 0 and not a.published[k])
            inside = sorted(((g, k) for k, g in a.g.items() if g > 0 and a.published[k]), key=lambda x: (-x[0], x[1]))
            run = 0.0
            for size, (g, _) in enumerate(inside, 1):
                run += g
                margin = run + outside - price(a.t, size, self.n, len(self.nodes), self.edits, len(self.first))
                if margin > 0 and (best is None or (-margin, seed, size) < best[:3]):
                    best = (-margin, seed, size, [k for _, k in inside[:size]], run + outside)
        if best is None:
            return None
        return self._mint(best[1], frozenset(best[3]), best[4], -best[0])

    def _mint(self, seed, support, released, margin) -> dict:
        a = self.accounts.pop(seed)
        self.last += 1
        nid = self.last
        node = Node(self.n, a.t, support, Counter({k: a.published[k] for k in support}), members=set(a.members))
        self.nodes[nid] = node
        self.edits += 1
        for m in a.members:
            for k in support & self.records[m].keys():
                self._give(m, k, nid)
        for k in support:
            self.by_key[k].add(nid)
        self._changed((nid,), support)
        receipt = {"node": nid, "n": self.n, "members": a.t, "released": released, "price": released - margin, "support": sorted(support), "seed_key": seed[0], "seed_value": seed[1], "bits": {k: a.g[k] for k in sorted(support)}}
        self.receipts.append(receipt)
        receipt["absorbed_by"] = self.absorb(nid)
        return receipt

    def _give(self, rec: int, key: str, nid: int) -> None:
        value, old, w = self.records[rec][key], self.owner[rec, key], self.weight[rec]
        self._known = None
        self._nodes_changed[old] += 1
        self._nodes_changed[nid] += 1
        if not old or not nid:
            self._keys_changed[key] += 1
        (self.nodes[old].blocks[key] if old else self.background[key]).add(value, -w)
        self.owner[rec, key] = nid
        if nid:
            self.nodes[nid].blocks[key].add(value, w)
            self.by_pair[key, value].add(nid)
        else:
            self.background[key].add(value, w)

    def _size(self, members) -> int:
        """How many records these are."""
        return sum(map(self.weight.__getitem__, members))

    def _with(self, key: str, members) -> int:
        """How many of these records have a key."""
        return sum(self.weight[m] for m in members if key in self.records[m])

    def _values(self, key: str, members) -> Counter:
        out: Counter = Counter()
        for m in members:
            if key in self.records[m]:
                out[self.records[m][key]] += self.weight[m]
        return out

    # the batch objective and repair

    def total(self) -> float:
        n, a, k = self.n, len(self.first), len(self.nodes)
        naming = {key: math.log2(len(v) + 1) for key, v in self.values.items()}
        out = _universal(k + 1) - (_lg2(k + 1) if k > 1 else 0.0)
        covered: dict[str, set] = defaultdict(set)
        for node in self.nodes.values():
            out += _column(node.t, n) + _support(len(node.support), a) if node.support else _column(node.t, n) + _universal(1)
            for key in node.support:
                out += _column(node.published[key], node.t) + node.blocks[key].bits(naming[key])
                covered[key] |= node.members
        for key, block in self.background.items():
            n0 = n - self._size(covered[key])
            p0 = self.published[key] - self._with(key, covered[key])
            out += (_column(min(p0, n0), n0) if n0 else 0.0) + block.bits(naming[key])
        return out

    def delete(self, nid: int) -> None:
        """A node's cells go to the background."""
        node = self.nodes[nid]
        for m in node.members:
            for k in self.records[m]:
                if self.owner[m, k] == nid:
                    self._give(m, k, 0)
        self._changed((nid,), node.support)
        self._forget(nid)
        self.edits += 1

    def merge(self, into: int, nid: int) -> None:
        """A node's members, support and cells go to another."""
        node, to = self.nodes[nid], self.nodes[into]
        for m in node.members:
            for k in self.records[m]:
                if self.owner[m, k] == nid:
                    self._give(m, k, into)
        to.members |= node.members
        to.t = self._size(to.members)
        to.support |= node.support
        to.published = Counter({k: self._with(k, to.members) for k in to.support})
        for k in to.support:
            self.by_key[k].add(into)
        self._changed((into, nid), to.support)
        self._forget(nid)
        self.edits += 1

    def _forget(self, nid: int) -> None:
        del self.nodes[nid]
        for index in (self.by_pair, self.by_key):
            for s in index.values():
                s.discard(nid)

    def reassign(self, rec: int, nid: int) -> None:
        """A record of no node joins one; the node takes its supported cells."""
        node = self.nodes[nid]
        node.members.add(rec)
        node.t += self.weight[rec]
        self._known = None
        for k in node.support & self.records[rec].keys():
            node.published[k] += self.weight[rec]
            self._give(rec, k, nid)
        for k in node.support:
            self._cover_one(k, rec)
            self._keys_changed[k] += 1
        self._nodes_changed[nid] += 1
        self._free_changed += 1

    def _changed(self, nodes, keys) -> None:
        """Nodes and the covers of keys are others now."""
        self._nodes_changed.update(nodes)
        self._keys_changed.update(keys)
        self._free_changed += 1
        self._known = None
        for k in keys:
            self._covers.pop(k, None)

    def _cover(self, key: str) -> list:
        """Of the nodes that support a key: how many hold each record; how many records they hold, and of these with the key."""
        if key not in self._covers:
            held = Counter(m for v in self.by_key[key] if v in self.nodes and key in self.nodes[v].support for m in self.nodes[v].members)
            self._covers[key] = [held, self._size(held), self._with(key, held)]
        return self._covers[key]

    def _cover_one(self, key: str, rec: int) -> None:
        if (c := self._covers.get(key)) is not None:
            c[0][rec] += 1
            if c[0][rec] == 1:
                c[1] += self.weight[rec]
                c[2] += self.weight[rec] * (key in self.records[rec])

    def _naming(self, key: str) -> float:
        return math.log2(len(self.values[key]) + 1)

    def _node_bits(self, t: int, support, published, counts: dict[str, Counter]) -> float:
        a = len(self.first)
        out = _column(t, self.n) + (_support(len(support), a) if support else _universal(1))
        for k in support:
            b = Block()
            b.counts, b.n = counts[k], sum(counts[k].values())
            out += _column(published[k], t) + b.bits(self._naming(k))
        return out

    def _bits_of(self, node: Node) -> float:
        return self._node_bits(node.t, node.support, node.published, {k: node.blocks[k].counts for k in node.support})

    def _presence(self, key: str, more=(), without: int | None = None) -> float:
        """The background's presence bits of a key if the records in more were covered too, or a node weren't there."""
        held, n1, p1 = self._cover(key)
        for m in more:
            if m not in held:
                n1 += self.weight[m]
                p1 += self.weight[m] * (key in self.records[m])
        if without is not None:
            for m in self.nodes[without].members:
                if held[m] == 1:
                    n1 -= self.weight[m]
                    p1 -= self.weight[m] * (key in self.records[m])
        n0, p0 = self.n - n1, self.published[key] - p1
        return _column(min(p0, n0), n0) if n0 else 0.0

    def _shape(self, change: int) -> float:
        at = lambda k: _universal(k + 1) - (_lg2(k + 1) if k > 1 else 0.0)
        return at(len(self.nodes) + change) - at(len(self.nodes))

    def merge_delta(self, into: int, nid: int, shaped: bool = True) -> float:
        """Change of total() by merge(into, nid); without the number of nodes, if not shaped."""
        a, b = self.nodes[into], self.nodes[nid]
        members, support = a.members | b.members, a.support | b.support
        published = {k: self._with(k, members) for k in support}
        counts = {k: (a.blocks[k].counts if k in a.blocks else Counter()) + (b.blocks[k].counts if k in b.blocks else Counter()) for k in support}
        out = self._node_bits(self._size(members), support, published, counts) - self._bits_of(a) - self._bits_of(b)
        for k in a.support ^ b.support:
            out += self._presence(k, members) - self._presence(k)
        return out + shaped * self._shape(-1)

    def delete_delta(self, nid: int, shaped: bool = True) -> float:
        """Change of total() by delete(nid)."""
        node = self.nodes[nid]
        out = -self._bits_of(node)
        for k in node.support:
            out += self._presence(k, (), nid) - self._presence(k)
            b = Block()
            b.counts = self.background[k].counts + node.blocks[k].counts
            b.n = sum(b.counts.values())
            out += b.bits(self._naming(k)) - self.background[k].bits(self._naming(k))
        return out + shaped * self._shape(-1)

    def cohort_delta(self, nid: int, cohort: list[int]) -> float:
        """Change of total() if records of no node join together."""
        node = self.nodes[nid]
        members = node.members | set(cohort)
        published, counts, out = {}, {}, 0.0
        for k in node.support:
            moved = self._values(k, cohort)
            published[k] = node.published[k] + sum(moved.values())
            counts[k] = node.blocks[k].counts + moved
            b = Block()
            b.counts = self.background[k].counts - moved
            b.n = sum(b.counts.values())
            out += b.bits(self._naming(k)) - self.background[k].bits(self._naming(k))
            out += self._presence(k, cohort) - self._presence(k)
        return out + self._node_bits(self._size(members), node.support, published, counts) - self._bits_of(node)

    def _cohort(self, nid: int) -> list[int]:
        support = self.nodes[nid].support
        return [m for m in self._free() if support & self.records[m].keys()]

    def _free(self) -> list[int]:
        """Records of no node."""
        taken = set().union(*(x.members for x in self.nodes.values()))
        return [m for m in self.records if m not in taken]

    def absorb(self, nid: int) -> int:
        """A new node joins nodes whose support holds its own or is held by it, while the total falls; the node that is left."""
        while True:
            near = [v for v in self.nodes if v != nid and (self.nodes[v].support <= self.nodes[nid].support or self.nodes[v].support >= self.nodes[nid].support)]
            best = min(((self.merge_delta(v, nid), self.nodes[v].born, v) for v in near), default=(0.0, 0, 0))
            if best[0] >= -1e-9:
                return nid
            self.merge(best[2], nid)
            nid = best[2]

    def repair(self, final: bool = False) -> int:
        """Rounds of merges, joint reassignments and deletes, each the best first and until none pays, while the total falls; number of moves.

        The final pass takes splits and mints out of the residual as well: during the stream they would decide on partial evidence.
        """
        kinds = [("merge", self._merges), ("cohort", self._cohorts), ("delete", self._deletes)]
        if final:
            kinds += [("split", self._splits), ("residual_mint", self._residual_mints)]
        moves = 0
        while True:
            before = moves
            for name, trials in kinds:
                while (best := min(trials(), key=lambda x: x[:2], default=(0.0, ())))[0] < -1e-9:
                    self._move(name, (*best[1], *best[2:]))
                    moves += 1
            if moves == before:
                return moves

    def _ids(self) -> list[int]:
        return sorted(self.nodes, key=lambda v: (self.nodes[v].born, v))

    def _priced(self, what: str, ids: tuple[int, ...], keys, price, also: int = 0):
        """price() again only if the nodes, the keys' covers or the background's blocks of these keys have changed since."""
        state = (self.n, also, sum(map(self._keys_changed.__getitem__, keys)), *map(self._nodes_changed.__getitem__, ids))
        known = self._prices.get((what, ids))
        if known is None or known[0] != state:
            known = self._prices[what, ids] = (state, price())
        return known[1]

    def _merges(self) -> list[tuple]:
        ids, shape = self._ids(), self._shape(-1) if self.nodes else 0.0
        pairs = ((a, b, self.nodes[a].support, self.nodes[b].support) for i, a in enumerate(ids) for b in ids[i + 1 :])
        return [(self._priced("merge", (a, b), s ^ t, lambda a=a, b=b: self.merge_delta(a, b, False)) + shape, (a, b)) for a, b, s, t in pairs if s & t]

    def _cohorts(self) -> list[tuple]:
        """Also what the free records have in common with a node's support is priced once, until they or the node change."""
        free = self._free()

        def price(v: int):
            c = [m for m in free if self.nodes[v].support & self.records[m].keys()]
            return self.cohort_delta(v, c) if c else None

        priced = [(self._priced("cohort", (v,), self.nodes[v].support, lambda v=v: price(v), self._free_changed), (v,)) for v in self._ids()]
        return [x for x in priced if x[0] is not None]

    def _deletes(self) -> list[tuple]:
        shape = self._shape(-1) if self.nodes else 0.0
        return [(self._priced("delete", (v,), self.nodes[v].support, lambda v=v: self.delete_delta(v, False)) + shape, (v,)) for v in self._ids()]

    def _splits(self) -> list[tuple]:
        shape = self._shape(1)
        found = [(self._priced("split", (v,), (), lambda v=v: self._best_part(v, 64)), v) for v in self._ids()]
        return [(best[0] + shape, (v,), best[1]) for best, v in found if best and best[0] + shape < -1e-9]

    def _residual_mints(self) -> list[tuple]:
        return [(found[0], (), *found[1:])] if (found := self.best_residual_mint()) else []

    def split_delta(self, nid: int, part: set[int], shaped: bool = True) -> float:
        """Change of total() if a node's members part in two with its whole support; the background stays."""
        node = self.nodes[nid]
        out = -self._bits_of(node)
        for side in (node.members & part, node.members - part):
            counts = {k: self._values(k, (m for m in side if self.owner.get((m, k)) == nid)) for k in node.support}
            out += self._node_bits(self._size(side), node.support, {k: self._with(k, side) for k in node.support}, counts)
        return out + shaped * self._shape(1)

    def split(self, nid: int, part: set[int]) -> int:
        """Members in part become a node of their own; its id."""
        node = self.nodes[nid]
        self.last += 1
        new = Node(self.n, 0, node.support)
        self.nodes[self.last] = new
        new.members = node.members & part
        new.t = self._size(new.members)
        node.members = node.members - part
        node.t = self._size(node.members)
        for x in (node, new):
            x.published = Counter({k: self._with(k, x.members) for k in x.support})
        for k in node.support:
            self.by_key[k].add(self.last)
        for m in new.members:
            for k in node.support & self.records[m].keys():
                if self.owner[m, k] == nid:
                    self._give(m, k, self.last)
        self.edits += 1
        self._changed((nid, self.last), node.support)
        return self.last

    def best_split(self, nid: int, most: int = 64) -> tuple[float, set[int]] | None:
        """The best part by its delta and the bits that name it: members with a (key, value), the commonest pairs first, and each grown once."""
        best = self._best_part(nid, most)
        if best is None:
            return None
        delta = best[0] + self._shape(1)
        return (delta, best[1]) if delta < -1e-9 else None

    def _best_part(self, nid: int, most: int) -> tuple[float, set[int]] | None:
        tried = self._parts(self.nodes[nid].members, most, 2)
        if not tried:
            return None
        seen: dict[frozenset, float] = {}
        for part in tried:
            if (key := frozenset(part)) not in seen:
                seen[key] = self.split_delta(nid, part, False)
        best = min(seen, key=seen.__getitem__)
        return seen[best] + math.log2(len(tried)), set(best)

    def _parts(self, members: set[int], most: int, least: int) -> list[set[int]]:
        """Proper parts: members with a (key, value), the commonest pairs first, and each grown once; the rest has least members or more before it grows."""
        pairs: dict[tuple[str, str], set[int]] = defaultdict(set)
        for m in members:
            for kv in self.records[m].items():
                pairs[kv].add(m)
        size, every = {kv: self._size(s) for kv, s in pairs.items()}, self._size(members)
        seeds = sorted((kv for kv, t in size.items() if 1 < t <= every - least), key=lambda kv: (-size[kv], kv))[:most]
        return [p for kv in seeds for p in (pairs[kv], self._grow(members, pairs[kv])) if 0 < len(p) < len(members)]

    def _grow(self, members: set[int], seed: set[int]) -> set[int]:
        """Each member to the half under whose value counts (all keys) it is cheaper."""
        halves = [defaultdict(Counter), defaultdict(Counter)]
        for m in members:
            for k, v in self.records[m].items():
                halves[m not in seed][k][v] += self.weight[m]
        totals = [{k: sum(c.values()) for k, c in half.items()} for half in halves]
        pairs = {(k, v) for half in halves for k, c in half.items() for v in c}
        bits = [{(k, v): _kt(halves[h][k][v], totals[h].get(k, 0), len(self.values[k])) for k, v in pairs} for h in (0, 1)]
        nearer: dict[tuple, bool] = {}  # records alike go alike
        out = set()
        for m in members:
            alike = tuple(self.records[m].items())
            if alike not in nearer:
                nearer[alike] = sum(map(bits[0].__getitem__, alike)) <= sum(map(bits[1].__getitem__, alike))
            if nearer[alike]:
                out.add(m)
        return out

    def best_residual_mint(self, most: int = 64) -> tuple[float, set[int], frozenset] | None:
        """The best node out of records of no node, with all of their keys: its delta and the bits that name it, members and support."""
        free = {m for m in self._free() if self.records[m]}
        tried = [(p, frozenset().union(*(self.records[m] for m in p))) for p in self._parts(free, most, 1)]
        if not tried:
            return None
        deltas = [self.residual_delta(p, support) for p, support in tried]
        best = min(range(len(tried)), key=deltas.__getitem__)
        delta = deltas[best] + math.log2(len(tried))
        return (delta, set(tried[best][0]), tried[best][1]) if delta < -1e-9 else None

    def residual_delta(self, members: set[int], support: frozenset) -> float:
        """Change of total() if records of no node become one."""
        out, published, counts = self._shape(1), {}, {}
        for k in support:
            counts[k] = self._values(k, (m for m in members if k in self.records[m] and not self.owner[m, k]))
            published[k] = self._with(k, members)
            b = Block()
            b.counts = self.background[k].counts - counts[k]
            b.n = sum(b.counts.values())
            out += b.bits(self._naming(k)) - self.background[k].bits(self._naming(k))
            out += self._presence(k, members) - self._presence(k)
        return out + self._node_bits(self._size(members), support, published, counts)

    def residual_mint(self, members: set[int], support: frozenset) -> int:
        self.last += 1
        node = Node(self.n, self._size(members), support, Counter({k: self._with(k, members) for k in support}), members=set(members))
        self.nodes[self.last] = node
        for k in support:
            self.by_key[k].add(self.last)
        for m in members:
            for k in support & self.records[m].keys():
                if not self.owner[m, k]:
                    self._give(m, k, self.last)
        self.edits += 1
        self._changed((self.last,), support)
        return self.last

    def _move(self, name: str, args: tuple) -> None:
        if name == "cohort":
            for m in self._cohort(args[0]):
                self.reassign(m, args[0])
        else:
            getattr(self, name)(*args)

    def labels(self) -> dict[int, int]:
        """Each record's largest node, the lowest id of equals; -1 without any."""
        out = {m: -1 for m in self.records}
        for v, node in sorted(self.nodes.items(), key=lambda x: (x[1].t, -x[0])):
            for m in node.members:
                out[m] = v
        return {n: out[m] for n, m in enumerate(self.place, 1)}


#: Records between two repairs.
EVERY = 100
#: Rows that a task gives out at a time.
BATCH = 100_000


def _feed(learner: Learner, records, every: int) -> None:
    for rec in records:
        learner.process(dict(rec))
        if every and learner.n % every == 0 and learner.nodes:
            learner.repair()


def run(records: DataFrame, by: str = "stream", every: int = EVERY, final: bool = True) -> DataFrame:
    """(by, rec_id, rec) to (by, rec_id, label): each stream learned in arrival order, in one task, which takes it in batches."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = learner = None
        ids = array("q")

        def labelled() -> Iterator[pd.DataFrame]:
            if final:
                learner.repair(final=True)
            label = learner.labels()
            for k in range(0, len(ids), BATCH):
                some = list(ids[k : k + BATCH])
                yield pd.DataFrame({by: [stream] * len(some), "rec_id": some, "label": [label[i] for i in range(k + 1, k + len(some) + 1)]})

        for batch in batches:
            for name, rows in batch.groupby(by, sort=False, dropna=False):
                if learner is None or not (name == stream or pd.isna(name) and pd.isna(stream)):
                    if learner is not None:
                        yield from labelled()
                    stream, learner, ids = (None if pd.isna(name) else name), Learner(alike=True), array("q")
                ids.extend(rows["rec_id"].tolist())
                _feed(learner, rows["rec"], every)
        if learner is not None:
            yield from labelled()

    kind = records.schema[by].dataType.simpleString()
    rows = records.select(by, F.col("rec_id").cast("long").alias("rec_id"), "rec").repartition(by).sortWithinPartitions(by, "rec_id", F.map_entries("rec"))
    return rows.mapInPandas(learn, f"{by} {kind}, rec_id bigint, label bigint")


def summary(records: DataFrame, by: str = "stream", every: int = EVERY, final: bool = True) -> DataFrame:
    """One row for each stream: records, nodes, total bits, edits, receipts (JSON)."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        learner = Learner(alike=True)
        _feed(learner, (rec for _, rec in sorted(zip(pdf["rec_id"], pdf["rec"]))), every)
        if final:
            learner.repair(final=True)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "records": [learner.n], "nodes": [len(learner.nodes)], "bits": [learner.total()], "edits": [learner.edits], "receipts": [json.dumps(learner.receipts)]})

    kind = records.schema[by].dataType.simpleString()
    return records.select(by, "rec_id", "rec").groupBy(by).applyInPandas(learn, f"{by} {kind}, records bigint, nodes bigint, bits double, edits bigint, receipts string")


def consensus(records: DataFrame, orders: int = 3, seed: int = 0) -> DataFrame:
    """run, rec_id, label, bits: the stream learned in several hash orders; the run of fewest bits is the answer."""
    runs = records.select(F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("run"), "rec_id", "rec").withColumn("at", F.xxhash64("rec_id", "run", F.lit(seed)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "rec_id"])
        learner = Learner(alike=True)
        _feed(learner, pdf["rec"], EVERY)
        learner.repair(final=True)
        label = learner.labels()
        return pd.DataFrame({"run": pdf["run"], "rec_id": pdf["rec_id"], "label": [label[k] for k in range(1, len(pdf) + 1)], "bits": learner.total()})

    return runs.groupBy("run").applyInPandas(learn, "run int, rec_id bigint, label bigint, bits double")


