"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are split into size windows: each window holds sizes from ``a`` to
``a / similarity ** 2`` and the next begins at ``a / similarity``, so two sets
that are similar enough are together in one window. There, two such sets differ
in at most ``k`` shingles. The shingle domain (64-bit hashes) is cut into
``n1`` equal ranges, each into ``n2`` smaller ones; every ``n2 - k2`` of these
make one signature, the sum of what the set has there. By counting, one of the
``n1`` ranges holds at most ``k2`` differences, and so one signature agrees.
Signatures of ranges without any shingle would agree among unrelated sets;
they are left out wherever enough other ranges are left for the count
(``_signatures``), which keeps the join exact.

Signatures are packed per bucket and met there; inside a batch, and then in a
bucket, a signature that several documents share gives a chain of edges, never
pairs. Components of these edges hold all candidates. Where many texts share a
passage, signatures of few shingles chain them into a component that is far
larger than any group of similar sets. A component beyond ``tile_shingles`` is
therefore taken apart first. A set similar to another shares the similarity's
share of its shingles, so sets go of which too few stand in any other set of
these components (``shared_shingles``). If that isn't enough, of each set the
rarest shingles count as signatures, as many as a similar set must share one of (all but the similarity's
share of it, and one). Rarity is by a table of hashed counts over these
documents; any order gives the same links. Inside components, one document of
each distinct set is compared exactly (``den * intersection >=
num * union`` on the sets); a component beyond ``tile_shingles`` is cut into
blocks and each two blocks meet in a task of their own, so no task holds an
unbounded group. Links between tiles are joined by connected components.

Defined results: null, empty and wordless texts have no shingles and link with
nothing; rows that share a doc_id take part each on its own and share the
component of any; rows with a null doc_id get null results; other columns are kept by
``keep_one`` and not read otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import LOWER, arrow_batches, drop_folder, large_apart, lean, lean_group, materialize, mix, parts, read, text_slices, word_hashes, word_places
from bitquarry.llm._components import components, contract

WIDTH = 4
NUMERATOR, DENOMINATOR = 85, 100
N2, K2 = 3, 1
TILE_SHINGLES = 1_500_000
BUCKET_DOCS = 4_000
#: bins of the table of counts (broadcast, 8 MB whatever the input)
BINS = 1 << 21

#: shingles that one task meets when those that stand once are counted out
SHARED_SHINGLES = 3_000_000

#: words of 64 bits in the filter of ids (broadcast, a row for each, whatever the input)
WORDS = 1 << 18

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    for part in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, 1 << 20):
        raw, starts, ends, first = word_places(part.column(0), LOWER)
        h = word_hashes(raw, starts, ends)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - width + 1)
            rolled = np.zeros(n, np.uint64)
            for j in range(width):
                rolled = rolled * _MIX2 + h[j : j + n]
            rolled = mix(rolled ^ _STEP)
            for a, b in zip(first.tolist(), first[1:].tolist()):
                if b - a >= width:
                    s = np.sort(rolled[a : b - width + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                elif b > a:
                    whole = np.zeros(1, np.uint64)
                    for x in h[a:b]:
                        whole = whole * _MIX1 + x
                    yield mix(whole ^ np.uint64(b - a))
                else:
                    yield np.empty(0, np.uint64)


@lru_cache(100_000)
def windows(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[tuple[int, int], ...]:
    """(window, differences k) of the size windows that sets of n shingles belong to."""
    out = []
    g = num / den
    i = max(0, int(math.log(max(n, 1)) / -math.log(g)) - 3)
    while True:
        low, high = g**-i, g ** -(i + 2)
        if low > n * (1 + 1e-9):
            return tuple(out)
        if n <= high * (1 + 1e-9):
            top = math.floor(high * (1 + 1e-9))
            # |r| + |s| <= top + top, and one of the two is at most num / den of the other's
            out.append((i, math.floor(2 * top * (den - num) / (den + num) + 1e-9)))
        i += 1


@lru_cache(10_000)
def _shape(k: int, low: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and how many ranges without an empty signature make a set regular, for sets of ``low`` shingles or more.

    ``need`` ranges are enough for one with at most k2 differences. There are
    as many more as ranges with an empty signature are to be expected (and 2.5
    deviations), so that nearly all sets are regular; very small sets can't be.
    """
    if k == 0:
        return 1, 1, 0, 1
    need = k // (K2 + 1) + 1

    def short(more: int) -> float:
        bare = min(1.0, math.comb(N2, K2) * math.exp(-(N2 - K2) * low / ((need + more) * N2))) * (need + more)
        return bare + 2.5 * math.sqrt(bare) - more

    more = min(range(need + 1), key=lambda e: (max(0.0, short(e)), e))
    return need + more, N2, K2, need


def _sign(h: np.ndarray, sums: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[np.ndarray]:
    """Signatures of a set: sorted hashes h; sums: running sums of mixed hashes, with a 0 before."""
    out = []
    for window, k in windows(len(h), num, den):
        n1, n2, k2, need = _shape(k, math.ceil((den / num) ** window - 1e-9))
        m = n1 * n2
        edges = np.searchsorted(h >> np.uint64(11), (np.arange(1, m, dtype=np.float64) * (2.0**53 / m)).astype(np.uint64))
        edges = np.concatenate([[0], edges, [len(h)]])
        part = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, n2)
        size = np.diff(edges).reshape(n1, n2)
        combos = list(combinations(range(n2), n2 - k2))
        sig = np.stack([sum((mix(part[:, j] + _STEP * np.uint64(j + 1)) for j in c), np.zeros(n1, np.uint64)) + np.uint64(t) for t, c in enumerate(combos)], 1)
        full = np.stack([sum(size[:, j] for j in c) > 0 for c in combos], 1)
        sig = mix(sig + np.arange(n1, dtype=np.uint64)[:, None] * _MIX1 + np.uint64(window + 1) * _MIX2)
        # Enough ranges whose every signature has a shingle: one of those agrees in any similar set
        out.append(sig[full] if full.all(1).sum() >= need else sig.reshape(-1))
    return out


_META = "bucket int, kind string, a binary, b binary, n binary"


def _packed(bucket: int, kind: str, *cols: np.ndarray) -> tuple:
    return (bucket, kind, *[c.tobytes() for c in cols], *[b""] * (3 - len(cols)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "a", "b", "n"])


_UNSIGNED = {2: np.uint16, 4: np.uint32, 8: np.uint64}


def _sent(sig: np.ndarray, doc: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Signatures of one bucket by their lower 48 bits, and their documents as distances from the smallest id, or as places among those, whichever is shorter.

    So a signature takes 8 to 10 bytes for ids that are near each other (within
    4,294,967,295), however few signatures of a batch fall into a bucket.
    """
    base = doc.min()
    off = doc.view(np.uint64) - base.view(np.uint64)
    off = off.astype(next(t for t in _UNSIGNED.values() if int(off.max()) <= np.iinfo(t).max))
    a = sig.astype(np.uint32).tobytes() + (sig >> np.uint64(32)).astype(np.uint16).tobytes()
    head = base.tobytes() + bytes([off.itemsize])
    if off.itemsize > 2:
        names, at = np.unique(off, return_inverse=True)
        at = at.astype(np.uint16 if len(names) < 65536 else np.uint32)
        if names.nbytes + at.nbytes < off.nbytes:
            return a, at.tobytes(), head + names.tobytes()
    return a, off.tobytes(), head


def _received(a: memoryview, b: memoryview, n: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """What ``_sent`` packed."""
    size = len(a) // 6
    sig = np.frombuffer(a, np.uint16, size, 4 * size).astype(np.uint64) << np.uint64(32)
    sig |= np.frombuffer(a, np.uint32, size)
    off = np.frombuffer(b, _UNSIGNED[len(b) // size])
    if len(n) > 9:
        off = np.frombuffer(n, _UNSIGNED[n[8]], offset=9)[off]
    return sig, (off.astype(np.uint64) + np.frombuffer(n, np.uint64, 1)).view(np.int64)


def _chain(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between documents that share a signature, as chains; and where each signature is first."""
    order = np.argsort(sig, kind="stable")
    s, d = sig[order], doc[order]
    same = s[1:] == s[:-1]
    return d[:-1][same], d[1:][same], order[np.concatenate([[True], ~same])] if len(s) else order


def hashed_counts(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many sets of docs hold a shingle of each bin."""
    chunk = 1 << 14

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large_apart()
        total = np.zeros(BINS, np.uint32)
        for b in batches:
            for h in shingle_sets(b.column(1), width):
                np.add.at(total, (h % np.uint64(BINS)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BINS // chunk), pa.int32()), pa.array([total[k : k + chunk].tobytes() for k in range(0, BINS, chunk)], pa.binary())], names=["chunk", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = sum((np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("n").to_pylist()), np.zeros(chunk, np.uint64))
        return pa.table([table.column("chunk").slice(0, 1), pa.array([np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "n"])

    out = np.zeros(BINS, np.uint32)
    for r in docs.select("doc_id", "text").mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary").collect():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["n"], np.uint32)
    return out


def shared_shingles(docs: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    """doc_id, shared: how many shingles of each document stand in another row of docs too.

    Shingles are met by 32 bits inside a bucket, so that a few count as shared
    that aren't; none is missed. Documents without any are left out. A bucket
    packs its counts by parts of the ids: a row for each bucket and part, not
    for each bucket and document.
    """

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large_apart()
        for b in (x for whole in batches for x in text_slices(whole, 1)):
            sets = list(shingle_sets(b.column(1), width))
            h = np.concatenate([*sets, np.empty(0, np.uint64)])
            to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(to, kind="stable")
            to, row, low = to[order], row[order], h[order].astype(np.uint32)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)] if len(to) else []
            rows = []
            for x, y in zip(cuts, cuts[1:]):
                names, n = np.unique(row[x:y], return_counts=True)
                rows.append(_packed(int(to[x]), "set", low[x:y], ids[names], n.astype(np.uint32)))
            for k in range(0, len(rows), 64):
                yield _batch(rows[k : k + 64])

    @lean_group
    def meet(table: pa.Table) -> pa.Table:
        low, ids, n = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("a", np.uint32), ("b", np.int64), ("n", np.uint32)))
        order = np.argsort(low, kind="stable")
        same = low[order[1:]] == low[order[:-1]]
        shared = np.zeros(len(low), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        count = np.add.reduceat(shared, np.cumsum(n, dtype=np.int64) - n, dtype=np.uint32)
        ids, count = ids[count > 0], count[count > 0]
        to = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ids, count, to = ids[order], count[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)] if len(to) else []
        return pa.Table.from_pylist([{"part": int(to[x]), "ids": ids[x:y].tobytes(), "n": count[x:y].tobytes()} for x, y in zip(cuts, cuts[1:])], parts_of)

    @lean_group
    def add(table: pa.Table) -> pa.Table:
        ids, n = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("ids", np.int64), ("n", np.uint32)))
        ids, at = np.unique(ids, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, n)
        return pa.table([pa.array(ids), pa.array(total)], names=["doc_id", "shared"])

    parts_of = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("n", pa.binary())])
    met = docs.select("doc_id", "text").mapInArrow(step, _META).groupBy("bucket").applyInArrow(meet, "part int, ids binary, n binary")
    return met.groupBy("part").applyInArrow(add, "doc_id bigint, shared bigint")


def _signatures(docs: DataFrame, buckets: int, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR, counts: Broadcast | None = None) -> DataFrame:
    """Per batch and bucket: signatures with their documents, and each document's size and set hash. counts: by rarest shingles."""

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large_apart()
        for b in (x for whole in batches for x in text_slices(whole, 1)):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            info: list[tuple] = []
            sigs: list[np.ndarray] = []
            owner: list[int] = []
            with np.errstate(over="ignore"):
                for d, h in zip(ids.tolist(), shingle_sets(b.column(1), width)):
                    m = mix(h + _STEP)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m)])
                    info.append((d, len(h), int(sums[-1]), int(np.bitwise_xor.reduce(mix(m ^ _MIX1))) if len(h) else 0))
                    if len(h):
                        if counts is None:
                            found = _sign(h, sums, num, den)
                        else:
                            often = counts.value[(h % np.uint64(BINS)).astype(np.int64)]
                            found = [mix(h[np.lexsort((h, often))[: len(h) + num * len(h) // -den + 1]])]
                        for s in found:
                            sigs.append(s)
                            owner.append(d)
                rows = [_packed(int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(buckets)), "info", np.array([x[0] for x in info], np.int64), np.array([x[1] for x in info], np.int64), np.array([x[2:] for x in info], np.uint64))]
                if sigs:
                    sig = np.concatenate(sigs)
                    doc = np.repeat(np.array(owner, np.int64), [len(s) for s in sigs])
                    u, v, first = _chain(sig, doc)
                    if len(u):
                        u, v = contract(u, v)
                        if len(u):
                            rows.append(_packed(int(mix(u[:1].astype(np.uint64))[0] % np.uint64(buckets)), "edge", u, v))
                    sig, doc = sig[first], doc[first]
                    to = (sig >> np.uint64(32)) % np.uint64(buckets)
                    order = np.argsort(to, kind="stable")
                    sig, doc, to = sig[order], doc[order], to[order]
                    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
                    for x, y in zip(cuts, cuts[1:]):
                        rows.append((int(to[x]), "sig", *_sent(sig[x:y], doc[x:y])))
            for k in range(0, len(rows), 64):
                yield _batch(rows[k : k + 64])

    return docs.mapInArrow(step, _META)


_OUT = "kind string, doc_id bigint, other bigint, h1 bigint, h2 bigint"


@lean_group
def _meet(table: pa.Table) -> pa.Table:
    """One bucket: chains of edges between documents that share a signature."""
    sigs, docs = [], []
    out: list[tuple[np.ndarray, np.ndarray]] = []
    infos: list[tuple] = []
    for kind, *packed in zip(table.column("kind").to_pylist(), *(table.column(c) for c in ("a", "b", "n"))):
        a, b, n = (memoryview(x.as_buffer()) for x in packed)
        if kind == "sig":
            s, d = _received(a, b, n)
            sigs.append(s)
            docs.append(d)
        elif kind == "edge":
            out.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
        else:
            infos.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(n, np.uint64).reshape(-1, 2).astype(np.int64)))
    if sigs:
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        del sigs, docs
        out.append(_chain(sig, doc)[:2])
        del sig, doc
    kinds: list[str] = []
    cols: list[list[np.ndarray]] = [[], [], [], []]
    if out:
        u, v = contract(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))
        kinds += ["edge"] * len(u)
        for c, x in zip(cols, (u, v, np.zeros(len(u), np.int64), np.zeros(len(u), np.int64))):
            c.append(x)
    for d, n, h in infos:
        kinds += ["info"] * len(d)
        for c, x in zip(cols, (d, n, h[:, 0], h[:, 1])):
            c.append(x)
    return pa.table([pa.array(kinds, pa.string()), *[pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols]], names=["kind", "doc_id", "other", "h1", "h2"])


def link_sets(ids: list[int], sets: list[np.ndarray], sides: list[int] | None = None, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Edges that join the documents with the same components as all their links. sides: only between sides 0 and 1.

    Documents go through in order of size. Each is counted against all earlier
    ones of near enough size at once, by an index from shingle to documents
    over its rarest shingles; one already in the same component is skipped.
    """
    n = len(ids)
    order = sorted(range(n), key=lambda k: (len(sets[k]), ids[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    # places as 32-bit numbers; what isn't needed further goes at once: a tile may have millions of shingles
    flat = np.concatenate([sets[k] for k in order])
    by_value = np.argsort(flat, kind="stable")
    flat = flat[by_value]
    fresh = np.concatenate([np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]])
    del flat
    rank = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    del fresh
    often = np.bincount(rank)
    at = np.empty(len(rank), np.int32)
    at[by_value] = rank
    del rank
    posting = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_value]
    del by_value
    starts = np.concatenate([[0], np.cumsum(often)])
    ends = np.cumsum(sizes)
    roots = np.arange(n)
    members: dict[int, list[int]] = {}
    side = np.array([sides[k] for k in order]) if sides else None
    mark = np.zeros(len(often), np.int32)
    edges = []
    for y in range(n):
        own = at[ends[y] - sizes[y] : ends[y]]
        need = -(-num * int(sizes[y]) // den)  # any similar set that isn't larger has so many of these shingles
        low = int(np.searchsorted(sizes, need))
        if low >= y:
            continue
        rare = own[np.argsort(often[own], kind="stable")[: len(own) - need + 1]]
        cand = np.unique(np.concatenate([posting[starts[v] : starts[v + 1]] for v in rare.tolist()]))
        cand = cand[(cand >= low) & (cand < y)][::-1]
        if side is not None:
            cand = cand[side[cand] != side[y]]
        mark[own] = 1
        while len(cand := cand[roots[cand] != roots[y]]):
            some, cand = cand[:32], cand[32:]
            places = np.concatenate([at[ends[x] - sizes[x] : ends[x]] for x in some.tolist()])
            shared = np.add.reduceat(mark[places], np.cumsum(sizes[some]) - sizes[some])
            for x in some[den * shared >= num * (sizes[some] + sizes[y] - shared)].tolist():
                big, small = int(roots[x]), int(roots[y])
                if big == small:
                    continue
                if len(members.get(big, ())) < len(members.get(small, ())):
                    big, small = small, big
                moved = members.pop(small, [small])
                members.setdefault(big, [big]).extend(moved)
                roots[moved] = big
                edges.append((ids[order[x]], ids[order[y]]))
        mark[own] = 0
    return edges


def _links(table: pa.Table, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> pa.Table:
    """Edges inside one tile."""
    ids = table.column("doc_id").to_pylist()
    blocks = table.column("block").to_pylist()
    sets = [s for chunk in table.column("text").chunks for s in shingle_sets(chunk, width)]
    two = len(set(blocks)) > 1
    edges = link_sets(ids, sets, [int(b > min(blocks)) for b in blocks] if two else None, num, den) if len(ids) > 1 else []
    return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def _perhaps(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is in ids, and some more (hashed ids); left_anti: docs that surely aren't. No row of docs is moved."""
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(64 * WORDS))
    bits = ids.select(at(F.col("doc_id")).alias("h")).groupBy(F.floor(F.col("h") / 64).alias("__bq_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("__bq_bits"))
    h = at(docs["doc_id"])
    hit = (F.floor(h / 64) == F.col("__bq_word")) & F.call_function("getbit", F.col("__bq_bits"), (h % 64).cast("int")).cast("boolean")
    return docs.join(F.broadcast(bits), hit, how)


def _sized(sets: DataFrame, tile_shingles: int) -> DataFrame:
    """Sets (root, doc_id, n, h1, h2) of the components of several, with the blocks that their component is cut into."""
    shape = sets.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).filter("sets > 1")
    return sets.join(shape, "root").withColumn("blocks", F.ceil(F.col("total") / tile_shingles).cast("int")).select("root", "doc_id", "n", "h1", "h2", "blocks")


def similar_groups(docs: DataFrame, tile_shingles: int = TILE_SHINGLES, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    arrow_batches(spark)

    @lean_group
    def linked(table: pa.Table) -> pa.Table:
        return _links(table, width, num, den)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = docs.filter("doc_id is not null")
    buckets = max(4 * parts(spark), whole.count() // BUCKET_DOCS)
    met = materialize(_signatures(whole, buckets, width, num, den).groupBy("bucket").applyInArrow(_meet, _OUT))
    info = met.filter("kind = 'info'").select("doc_id", F.col("other").alias("n"), "h1", "h2")
    candidates = components(met.filter("kind = 'edge'").select("doc_id", "other"))
    # one document of each distinct set goes on; a set's other documents are linked with it
    members = info.filter("n > 0").join(candidates, info["doc_id"] == candidates["node"]).select("root", "doc_id", "n", "h1", "h2")
    first = materialize(members.groupBy("root", "n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    copies = members.join(first.filter("copies > 1").select("root", "n", "h1", "h2", F.col("doc_id").alias("rep")), ["root", "n", "h1", "h2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sized = _sized(first, tile_shingles)
    large = sized.filter("blocks > 1")
    total = large.agg(F.sum("n")).first()[0]
    if total:
        # sets that may have a similar one among them
        shared = shared_shingles(_perhaps(whole, large), max(parts(spark), total // SHARED_SHINGLES), width)
        left = large.drop("blocks").join(shared, "doc_id").filter(F.col("shared") * den >= F.col("n") * num)
        sized = materialize(sized.filter("blocks = 1").unionByName(_sized(left, tile_shingles)))
        large = sized.filter("blocks > 1")
        if not large.isEmpty():
            some = _perhaps(whole, large)
            counts = spark.sparkContext.broadcast(hashed_counts(some, width))
            near = materialize(_signatures(some, buckets, width, num, den, counts).groupBy("bucket").applyInArrow(_meet, _OUT))
            finer = components(near.filter("kind = 'edge'").select("doc_id", "other")).withColumnsRenamed({"node": "doc_id"})
            sized = materialize(sized.filter("blocks = 1").unionByName(_sized(large.drop("root", "blocks").join(finer, "doc_id"), tile_shingles)))
    placed = sized.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    tiles = placed.select("root", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("root", "doc_id", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    # texts are dealt by doc_id at every size: candidates grow with the documents, so they are never broadcast; texts that surely are none stay where they are
    links = tiles.hint("merge").join(_perhaps(whole, sized), "doc_id").groupBy("root", "x", "y").applyInArrow(linked, "a bigint, b bigint")
    found = components(copies.unionByName(links))
    out = info.join(found, info["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    return out.unionByName(docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """docs with the smallest doc_id of each group of similar texts alone."""
    gone = materialize(similar_groups(docs, width=width, num=num, den=den).filter("doc_id <> component_id").select("doc_id").distinct())
    groups = gone.select(F.col("doc_id").alias("__bq_id"))
    some = _perhaps(docs, gone)
    # only documents that perhaps go are dealt by their ids
    return _perhaps(docs, gone, "left_anti").unionByName(some.join(groups.hint("merge"), some["doc_id"].cast("long") == groups["__bq_id"], "left_anti"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"), width=4, num=85, den=100)
