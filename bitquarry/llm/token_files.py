"""Token-id files: frequency-ranked ids, byte-aligned lengths, separate control bytes.

Ids are replaced by their rank in the corpus (0: most frequent), a rank takes 1
to 4 bytes without leading zeros, and the lengths of four ranks make one
control byte, kept apart from the data bytes. A reader looks a control byte up
in a table, which gives the four lengths and offsets at once, so numpy decodes
a block without a loop over its ids.

Files are Parquet as a container of blocks (control bytes, data bytes, the
documents' ids and lengths), in ascending doc_id order over the files, with the
rank table beside them.

Defined results: null and empty texts have just the end id; rows that share a
doc_id stay separate, in the order of their ids' checksum; a null doc_id stands
first; an empty table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, materialize, parts, read, shared_dir, text_slices
from bitquarry.llm._tokenize import encoder

BLOCK_IDS = 1 << 16

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_OFFSETS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup."""
    c = np.frombuffer(control, np.uint8)
    base = np.cumsum(_TOTALS[c]) - _TOTALS[c]
    at = (base[:, None] + _OFFSETS[c]).reshape(-1)[:n]
    length = _LENGTHS[c].reshape(-1)[:n]
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = length > k
        if not more.any():
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[length - 1]


def _crcs(ids: np.ndarray, starts: list[int]) -> list[int]:
    """Checksums of each text's ids as unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]


def encode(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and ids (unsigned 16-bit) of every whole text, end id included."""
    arrow_batches(docs.sparkSession)

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        for whole in batches:
            for b in text_slices(whole, 1):
                ids, starts = enc.encode_batch(b.column(1), end_id)
                raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(starts)), pa.array(_crcs(ids, starts.tolist()), pa.int64()), raw], names=["doc_id", "n_tokens", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit ids of a binary column, and where each row's begin (one more than rows)."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    ids = np.frombuffer(data, "<u2", int(offsets[-1] - offsets[0]) // 2, int(offsets[0])) if data and offsets[-1] > offsets[0] else np.zeros(0, "<u2")
    return ids, (offsets - offsets[0]) // 2


def ranks(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first; as many as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0))[0], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, keeps_space: bool = True) -> None:
    """Writes the file set of docs under path."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, tokenizer, end_id, keeps_space), compression="zstd")
    by_rank = ranks(encoded)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal before, held, size
            ids = np.concatenate([x for _, x, _ in held])
            control, data = pack(rank_of[ids])
            counts = np.concatenate([c for _, _, c in held])
            docs_ = pa.concat_arrays([d for d, _, _ in held])
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs_)], pa.int32()), docs_), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts)), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "before", "n", "doc_ids", "counts", "control", "data"])
            before += len(ids)
            held, size = [], 0
            return out

        for b in batches:
            ids, starts = _flat(b.column(1))
            at = 0
            while at < b.num_rows:  # as many rows as fill the block, the last one whole
                to = min(b.num_rows, int(np.searchsorted(starts, starts[at] + BLOCK_IDS - size)))
                held.append((b.column(0).slice(at, to - at), ids[starts[at] : starts[to]].copy(), np.diff(starts[at : to + 1])))
                size += int(starts[to] - starts[at])
                at = to
                if size >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    ordered = encoded.repartitionByRange(parts(spark), "doc_id", "ids_crc32").sortWithinPartitions("doc_id", "ids_crc32").select("doc_id", "ids")
    ordered.mapInArrow(lean(step), "part int, before bigint, n bigint, doc_ids array<bigint>, counts array<bigint>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files under path: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (unsigned 32-bit, little-endian)."""
    arrow_batches(spark)
    files = spark.read.parquet(f"{path}/blocks")
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["ids"], "<u4")
    base, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):  # a row for each written partition
        base[r.part], total = total, total + r.n

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for k in range(b.num_rows):
                ids = by_rank[unpack(at["control"][k].as_py(), at["data"][k].as_py(), at["n"][k].as_py())].astype("<u4")
                counts = at["counts"][k].values.to_numpy()
                ends = np.cumsum(counts)
                starts = [0, *ends.tolist()]
                start = base[at["part"][k].as_py()] + at["before"][k].as_py() + ends - counts
                cols = [at["doc_ids"][k].values, pa.array(start), pa.array(counts), pa.array(_crcs(ids, starts), pa.int64())]
                if with_ids:
                    raw = memoryview(ids).cast("B")
                    cols.append(pa.array([bytes(raw[4 * x : 4 * y]) for x, y in zip(starts, starts[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.mapInArrow(step, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = shared_dir(spark)
    write(read(spark, sf_dir, "documents"), tokenizer, 2, path)
    return load(spark, path, with_ids=False)
