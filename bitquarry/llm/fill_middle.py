"""Fill-in-middle: texts cut into prefix, middle and suffix at line ends, and put together in another order.

One scan: a table-driven automaton reads the UTF-8 bytes. Its states know
whether a line has begun and how much of a sentinel has been read; its classes
tell continuation bytes, line ends and the sentinels' letters apart. Each
transition emits what it completes: a code point, a unit (line) or a sentinel,
and these are counted. Texts are read in blocks of ``BLOCK`` bytes, all blocks
of a batch side by side: first every block is run from every state, which gives
its map of states; the maps of a text's blocks are chained, and the run from
the state that a block really begins in emits. So a long text costs what as
many short ones cost.

A second pass locates the cuts: the counts of blocks say which block holds the
unit that a part ends with, and the emissions of that block say where.

Defined results: null text is empty, has no units and stays plain, as does a
text that holds a sentinel; a null doc_id hashes as an empty one; repeated rows
give equal rows; an empty table gives an empty result; other columns are kept
by ``rearranged`` and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, read, text_bytes, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE = 100
SPM = 50
BLOCK = 256

# What a byte can be
OTHER, MORE, END, OPEN, LETTER, CLOSE, NOTHING = range(7)
# Where the automaton can be: before a line, in one, after "<" and after "<" and a sentinel's letter
FRESH, INSIDE, OPENED, NAMED = range(4)
# What a transition can complete
POINT, UNIT, SENTINEL = 1, 2, 4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state and emission of each state and class."""
    classes = np.full(256, OTHER, np.uint8)
    classes[0x80:0xC0] = MORE
    classes[ord("\n")] = END
    for mark in (PREFIX, SUFFIX, MIDDLE):
        classes[mark[0]], classes[mark[1]], classes[mark[2]] = OPEN, LETTER, CLOSE
    state = np.full((4, 7), INSIDE, np.uint8)
    emit = np.full((4, 7), POINT, np.uint8)
    emit[:, MORE] = 0
    state[:, END], emit[:, END] = FRESH, POINT | UNIT
    state[:, OPEN] = OPENED
    state[OPENED, LETTER] = NAMED
    emit[NAMED, CLOSE] = POINT | SENTINEL
    state[:, NOTHING], emit[:, NOTHING] = np.arange(4), 0
    return classes, state, emit


CLASSES, STATE, EMIT = _tables()


class Scan:
    """Counts of what each text completes, and where its units end."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        self.offsets = offsets
        lengths = np.diff(offsets)
        per = -(-lengths // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(per)])  # each text's first block
        blocks = int(self.first[-1])
        raw = np.full(blocks * BLOCK, NOTHING, np.uint8)
        raw[np.arange(len(data)) + np.repeat(self.first[:-1] * BLOCK - offsets[:-1], lengths)] = CLASSES[np.frombuffer(data, np.uint8)]
        columns = np.ascontiguousarray(raw.reshape(blocks, BLOCK).T)
        maps = np.repeat(np.arange(4, dtype=np.uint8)[:, None], blocks, 1)
        flat, width = STATE.ravel(), STATE.shape[1]
        for c in columns:
            maps = flat[maps * np.uint8(width) + c]
        chain = maps.T.tolist()
        begins = np.full(blocks, FRESH, np.uint8)
        ends = np.full(len(lengths), FRESH, np.uint8)
        for t, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist())):
            now = FRESH
            for k in range(a, b):
                begins[k] = now
                now = chain[k][now]
            ends[t] = now
        out = np.empty((BLOCK, blocks), np.uint8)
        now, emit = begins, EMIT.ravel()
        for i, c in enumerate(columns):
            at = now * np.uint8(width) + c
            out[i] = emit[at]
            now = flat[at]
        self.emitted = np.ascontiguousarray(out.T)
        count = lambda bit: np.concatenate([[0], np.cumsum(((self.emitted & bit) > 0).sum(1, dtype=np.int64))])
        self._points, self._units, sentinels = count(POINT), count(UNIT), count(SENTINEL)
        text = lambda sums: sums[self.first[1:]] - sums[self.first[:-1]]
        self.points = text(self._points)
        self.units = text(self._units) + (ends != FRESH)  # the last line may have no end
        self.sentinels = text(sentinels)

    def cut(self, text: int, units: int) -> tuple[int, int]:
        """Bytes and code points of the text's first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units >= self.units[text]:
            return int(self.offsets[text + 1] - self.offsets[text]), int(self.points[text])
        a, b = int(self.first[text]), int(self.first[text + 1])
        want = int(self._units[a]) + units
        k = a + int(np.searchsorted(self._units[a + 1 : b + 1], want))
        row = self.emitted[k]
        at = int(np.flatnonzero(row & UNIT)[want - int(self._units[k]) - 1]) + 1
        return (k - a) * BLOCK + at, int(self._points[k] - self._points[a]) + int(np.count_nonzero(row[:at] & POINT))


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """Four integers of 32 bits that the seed and doc_id fix."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearrange(ids: list, texts: pa.Array, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> dict[str, list]:
    """n, form, output (bytes), prefix_chars, middle_chars, cuts (bytes of prefix and of prefix and middle) of each text."""
    data, offsets = text_bytes(texts)
    scan = Scan(data, offsets)
    out: dict[str, list] = {"n": scan.units.tolist(), "form": [], "output": [], "prefix_chars": [], "middle_chars": [], "cuts": []}
    for t, (doc, n, marked) in enumerate(zip(ids, out["n"], scan.sentinels.tolist())):
        text = data[offsets[t] : offsets[t + 1]]
        h1, h2, h3, h4 = draws(doc, seed)
        if not text or marked or h3 % 100 >= rate:
            row = ("plain", text, None, None, None)
        else:
            (x, px), (y, py) = scan.cut(t, min(h1 % (n + 1), h2 % (n + 1))), scan.cut(t, max(h1 % (n + 1), h2 % (n + 1)))
            form = "spm" if h4 % 100 < spm else "psm"
            parts = (SUFFIX, text[y:], PREFIX, text[:x], MIDDLE, text[x:y]) if form == "spm" else (PREFIX, text[:x], SUFFIX, text[y:], MIDDLE, text[x:y])
            row = (form, b"".join(parts), px, py - px, [x, y])
        for name, value in zip(("form", "output", "prefix_chars", "middle_chars", "cuts"), row):
            out[name].append(value)
    return out


def rearranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with __bq_n, __bq_form, __bq_output, __bq_prefix and __bq_middle (code points), __bq_cuts (bytes)."""
    arrow_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text, doc = docs.columns.index("text"), docs.columns.index("doc_id")

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, text):
                out = rearrange(b.column(doc).to_pylist(), b.column(text), seed, rate, spm)
                more = [pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()), pa.array(out["output"], pa.binary()).cast(pa.string()), pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()), pa.array(out["cuts"], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "__bq_n", "__bq_form", "__bq_output", "__bq_prefix", "__bq_middle", "__bq_cuts"])

    return docs.mapInArrow(step, f"{schema}, __bq_n bigint, __bq_form string, __bq_output string, __bq_prefix bigint, __bq_middle bigint, __bq_cuts array<bigint>")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part of it holds a sentinel, so the sentinels say where parts end."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    p, s, m = PREFIX.decode(), SUFFIX.decode(), MIDDLE.decode()
    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearranged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("__bq_n").alias("n"), F.col("__bq_form").alias("form"), F.col("__bq_prefix").alias("prefix_chars"), F.col("__bq_middle").alias("middle_chars"),
        sha(F.col("__bq_output")).alias("output_sha256"), sha(restored(F.col("__bq_output"), F.col("__bq_form"))).alias("restored_sha256"),
    )


_UPTO = "CASE WHEN {u} >= n THEN t WHEN {u} = 0 THEN '' ELSE array_to_string(list_slice(string_split(t, chr(10)), 1, {u}), chr(10)) || chr(10) END"

#: The same rows by string functions of DuckDB.
ORACLE_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
    SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR t[-1] = chr(10) THEN 0 ELSE 1 END AS n,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (
    SELECT *, {_UPTO.format(u='a')} AS p, {_UPTO.format(u='b')} AS pm FROM f
), e AS (
    SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM e
"""
