"""Benchmark decontamination with a generalised suffix automaton.

The items' words make one generalised suffix automaton per block of items (a
block is bounded by ``block_words``, so what is broadcast is bounded; further
blocks are further narrow passes over the documents, without a shuffle).
Document words are streamed through it: the automaton keeps the longest suffix
of what was read that occurs in an item. Where that length reaches the window,
the last ``window`` words are a window of some item; an item of fewer words is
one window as a whole and is found along the suffix links.

Defined results: null or empty texts have no words and no hit; null items, and
items without words, have no window; repeated item rows count as one item_id;
repeated document rows give repeated result rows; empty tables give empty
results; items with a null item_id have no window; other columns are carried by ``remove`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import alnum_words, arrow_batches, lean, read

WINDOW = 13
COVERAGE_INVERSE = 20
BLOCK_WORDS = 400_000


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        texts: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            if words:
                ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words)
                texts.setdefault(ids, set()).add(item)
        ends: list[tuple[tuple[int, ...], set[str]]] = sorted(texts.items())
        for ids, _ in ends:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._annotate(ends)

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this word here already
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _annotate(self, ends: list[tuple[tuple[int, ...], set[str]]]) -> None:
        """windows[v]: items of the window that v's strings end with; short[v]: (words, items) of whole short items along the links."""
        n, w = len(self.next), self.window
        own: dict[int, set[str]] = {}
        short_own: dict[int, dict[int, set[str]]] = {}
        for ids, names in ends:
            v = 0
            for k, c in enumerate(ids, 1):
                v = self.next[v][c]
                if k >= w:
                    own.setdefault(self._at(v, w), set()).update(names)
            if len(ids) < w:
                short_own.setdefault(self._at(v, len(ids)), {}).setdefault(len(ids), set()).update(names)
        self.windows: list[frozenset | None] = [None] * n
        self.short: list[tuple | None] = [None] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= w:
                self.windows[v] = frozenset(own.get(v, ())) if self.length[up] < w else self.windows[up]
            mine = tuple((k, frozenset(x)) for k, x in short_own.get(v, {}).items())
            self.short[v] = (mine + (self.short[up] or ())) or None
        self.least = min([w, *(k for x in short_own.values() for k in x)])

    def _at(self, v: int, k: int) -> int:
        """The state of the suffix of k words of v's string."""
        while self.length[self.link[v]] >= k:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [from, to) of hit words, and the items with occurring windows."""
        nexts, link, length, w, least = self.next, self.link, self.length, self.window, self.least
        spans: list[list[int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        v = l = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = l = 0
                continue
            t = nexts[v].get(c)
            if t is None:
                while v and c not in nexts[v]:
                    v = link[v]
                t = nexts[v].get(c)
                if t is None:
                    v = l = 0
                    continue
                l = length[v] + 1
            else:
                l += 1
            v = t
            if l < least:
                continue
            hit = 0
            if l >= w:
                hit = w
                if v not in seen:
                    seen.add(v)
                    items |= self.windows[v]
            if self.short[v]:
                for k, names in self.short[v]:
                    if k <= l:
                        hit = max(hit, k)
                        items |= names
            if hit:
                a = i + 1 - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return spans, items


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, streamed to the driver in blocks of bounded size; one empty block if there are none."""
    block: list[tuple[str, list[bytes]]] = []
    size, done = 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = alnum_words(row["text"])
        if not words or row["item_id"] is None:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size, done = [], 0, True
        block.append((row["item_id"], words))
        size += len(words)
    if block or not done:
        yield block


_SPANS = [("__bq_spans", pa.list_(pa.list_(pa.int64()))), ("__bq_items", pa.list_(pa.string())), ("__bq_n", pa.int64())]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __bq_spans (hit word ranges), __bq_items (ids with occurring windows) and __bq_n (words)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs
    for block in blocks(benchmark, block_words):
        held = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        @lean
        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            auto = held.value
            for b in batches:
                names = b.schema.names
                had = "__bq_spans" in names
                old = [b.column(names.index(c)).to_pylist() for c, _ in _SPANS[:2]] if had else None
                got: list[list] = [[], [], []]
                for k, t in enumerate(b.column(names.index(text)).to_pylist()):
                    words = alnum_words(t)
                    spans, items = auto.scan(words)
                    if old:
                        spans, items = _merge([*old[0][k], *spans]), items | set(old[1][k])
                    for to, x in zip(got, (spans, sorted(items), len(words))):
                        to.append(x)
                keep = [(c, b.column(i)) for i, c in enumerate(names) if c not in dict(_SPANS)]
                cols = keep + [(c, pa.array(x, type=t)) for (c, t), x in zip(_SPANS, got)]
                yield pa.RecordBatch.from_arrays([x for _, x in cols], names=[c for c, _ in cols])

        out = out.mapInArrow(step, f"{schema}, __bq_spans array<array<bigint>>, __bq_items array<string>, __bq_n bigint")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = scan(docs.select("doc_id", "text"), benchmark, window=window)
    n_hit = F.aggregate("__bq_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = spans.select("doc_id", F.col("__bq_n").alias("n_words"), n_hit.alias("n_hit"), F.size("__bq_items").cast("long").alias("n_items"), F.sha2(F.array_join("__bq_items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE_INVERSE * F.col("n_hit") >= F.col("n_words")))


def cut(text: str, spans: list[list[int]]) -> str:
    """text without the words of the spans and what stands between them."""
    out, at = [], 0
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, action: str = "drop", max_span: int | None = None, window: int = WINDOW) -> DataFrame:
    """docs without contamination, with all their columns.

    Over the coverage limit (a twentieth of the words), action "drop" drops the
    document and "cut" cuts the hit spans out of its text. max_span: spans of
    more words are cut from documents below the coverage limit too.
    """
    if action not in ("drop", "cut"):
        raise ValueError("action is drop or cut")
    names = docs.columns
    found = scan(docs, benchmark, window=window)
    n_hit = F.aggregate("__bq_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    bad = (n_hit > 0) & (COVERAGE_INVERSE * n_hit >= F.col("__bq_n"))
    if action == "drop":
        found = found.filter(~bad)
        if max_span is None:
            return found.select(*[F.col(f"`{c}`") for c in names])
    limit = max_span if max_span is not None else 1 << 60
    cover = action == "cut"

    @lean
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            texts = []
            for t, spans, n in zip(*(b.column(at[c]).to_pylist() for c in ("text", "__bq_spans", "__bq_n"))):
                hit = sum(y - x for x, y in spans)
                every = cover and hit and COVERAGE_INVERSE * hit >= n
                spans = [s for s in spans if every or s[1] - s[0] > limit]
                texts.append(cut(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(at[c]) for c in names], names=names)

    return found.mapInArrow(apply, docs.schema)


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
