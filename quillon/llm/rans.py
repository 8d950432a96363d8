"""Token ids in binary blocks, compressed by a static range asymmetric numeral system.

One frequency table, counted over all ids of the corpus and scaled to ``1 << BITS``, is shared by all blocks. A block
holds the ids of consecutive documents and is independent of other blocks: ``LANES`` interleaved coder states take turns
(id k belongs to lane k mod LANES), so numpy codes a whole row of ids at once. Every ``STRIDE`` rows a checkpoint keeps
all states and the place in the stream: a reader can start at any checkpoint, and several can decode one block side by
side. A checksum covers the header and the body, another the ids.

Blocks are rows of a Parquet table (binary column ``block``), written by Spark's own committer: a lost executor's
attempt leaves nothing behind. Ids are in ascending doc_id order; equal ids by text. Null text counts as empty.
An empty table gives no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import binary_rows, cached_bpe, default_vocabulary
from .common import Stage, has_columns, small_batches

MAGIC, VERSION = b"QRNS", 1
BITS = 20
LOW = np.uint64(1 << 31)
LANES = 4096
STRIDE = 64
BLOCK_IDS = 1 << 19
#: The starts of up to so many blocks (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000
END_ID = 2
_HEADER = struct.Struct("<4sHHIIIII")  # magic, version, bits, lanes, stride, ids, documents, words of the stream


class CorruptBlock(ValueError):
    """A checksum or a header doesn't fit."""


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integer frequencies that sum to ``1 << bits``; every id that occurs gets one at least."""
    counts = np.asarray(counts, dtype=np.float64)
    total, goal = counts.sum(), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * goal / total)), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = goal - int(out.sum())
    if spare > 0:
        out[order[0]] += spare
    k = 0
    while spare < 0:  # taken from the most frequent ids
        take = min(-spare, int(out[order[k]]) - 1)
        out[order[k]] -= take
        spare, k = spare + take, k + 1
    return out


class Table:
    """Frequencies, their running sums, and the id of every slot."""

    def __init__(self, freqs: np.ndarray):
        self.freq = freqs.astype(np.uint64)
        self.start = (np.cumsum(freqs) - freqs).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)
        self.crc = zlib.crc32(freqs.astype("<u4"))


def encode(ids: np.ndarray, documents: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """A block of ids; ``documents`` has the number of ids of each document."""
    n = len(ids)
    rows = -(-n // lanes)
    bits, shift = np.uint64(BITS), np.uint64(63 - BITS)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    emitted = 0
    for row in range(rows - 1, -1, -1):  # a coder is a stack: the last row goes in first
        if row % stride == stride - 1 and row != rows - 1:
            marks.append((emitted, state.astype("<u8").tobytes()))
        part = ids[row * lanes : (row + 1) * lanes]
        x = state[: len(part)]
        f, c = table.freq[part], table.start[part]
        over = x >= (f << shift)
        if over.any():
            out = x[over]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            emitted += len(out)
            x[over] = out >> np.uint64(32)
        q = x // f
        x[:] = (q << bits) + (x - q * f) + c
    body = b"".join(w.tobytes() for w in words)
    stream = np.frombuffer(body, "<u4")[::-1].tobytes()
    head = _HEADER.pack(MAGIC, VERSION, BITS, lanes, stride, n, len(documents), emitted) + struct.pack("<II", table.crc, len(marks))
    head += documents.astype("<u4").tobytes() + state.astype("<u8").tobytes() + b"".join(struct.pack("<I", emitted - at) + s for at, s in reversed(marks))
    ids_crc = zlib.crc32(ids.astype("<u4"))
    whole = head + stream + struct.pack("<I", ids_crc)
    return whole + struct.pack("<I", zlib.crc32(whole))


def decode(block: bytes, table: Table, checkpoint: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document); with ``checkpoint`` only the rows from there to the next one, checked by the block's own checksum."""
    if len(block) < _HEADER.size + 16 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise CorruptBlock("the block's checksum doesn't fit")
    magic, version, bits, lanes, stride, n, docs, emitted = _HEADER.unpack_from(block)
    crc, n_marks = struct.unpack_from("<II", block, _HEADER.size)
    if (magic, version, bits) != (MAGIC, VERSION, BITS) or crc != table.crc:
        raise CorruptBlock("another format or another frequency table")
    at = _HEADER.size + 8
    documents = np.frombuffer(block, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    state = np.frombuffer(block, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    marks = at
    stream = np.frombuffer(block, "<u4", emitted, at + n_marks * (4 + 8 * lanes))
    rows, first, read = -(-n // lanes), 0, 0
    last = rows
    if checkpoint is not None:
        if checkpoint:
            where = marks + (checkpoint - 1) * (4 + 8 * lanes)
            read = struct.unpack_from("<I", block, where)[0]
            state = np.frombuffer(block, "<u8", lanes, where + 4).astype(np.uint64)
        first, last = checkpoint * stride, min(rows, (checkpoint + 1) * stride)
    end = min(n, last * lanes)
    ids = np.empty(end - first * lanes, np.uint32)
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for row in range(first, last):
        x = state[: min(lanes, n - row * lanes)]
        low = x & mask
        got = table.slot[low]
        ids[(row - first) * lanes : (row - first) * lanes + len(x)] = got
        x[:] = table.freq[got] * (x >> shift) + low - table.start[got]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << np.uint64(32)) | stream[read : read + len(under)]
            read += len(under)
    if checkpoint is None and zlib.crc32(ids.astype("<u4")) != struct.unpack("<I", block[-8:-4])[0]:
        raise CorruptBlock("the ids' checksum doesn't fit")
    return ids, documents


def _tokens(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary, the vocabulary's width) of each row."""
    docs = has_columns(docs, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(vocabulary)
        for batch in batches:
            for at, data, bounds in bpe.encode_column(batch.column(1), end_id):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), binary_rows(data, bounds)], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _histogram(tokens: DataFrame, width: np.dtype) -> DataFrame:
    """id and number of times, from one partial histogram a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in small_batches(batches):
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(got) > len(counts):
                counts, got = got, counts
            counts[: len(got)] += got
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(spark: SparkSession, docs: DataFrame, vocabulary: str, stage: Stage, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, Table]:
    """Encodes all documents; returns the written table of blocks (part, nth, first_doc, docs, ids, block) and the frequency table."""
    width = cached_bpe(vocabulary).dtype
    tokens = stage.table(_tokens(docs, vocabulary, end_id), "tokens")
    counts = np.zeros(cached_bpe(vocabulary).tokenizer.get_vocab_size(), np.int64)
    for row in _histogram(tokens, width).collect():  # at most as many rows as the vocabulary
        counts[row["id"]] = row["n"]
    freqs = scaled(counts)
    shared = spark.sparkContext.broadcast(freqs)  # as long as the vocabulary
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, nth = Table(shared.value), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        keys: list = []
        size = 0

        def block() -> pa.RecordBatch:
            documents = np.array([len(x) // width.itemsize for x in held], np.int64)
            data = encode(np.frombuffer(b"".join(held), width).astype(np.int64), documents, table)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([int(documents.sum())], pa.int64()), pa.array([keys]), pa.array([data], pa.binary())], names=["part", "nth", "docs", "ids", "doc_ids", "block"])

        for batch in small_batches(batches, 256):
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(ids)
                keys.append(key)
                size += len(ids) // width.itemsize
                if size >= block_ids:
                    yield block()
                    held, keys, size, nth = [], [], 0, nth + 1
        if held:
            yield block()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = stage.table(ordered.mapInArrow(run, f"part int, nth int, docs bigint, ids bigint, doc_ids array<{kind}>, block binary"), "blocks", "uncompressed")
    stage.drop("tokens")
    return blocks, Table(freqs)


def read(spark: SparkSession, blocks: DataFrame, table: Table) -> DataFrame:
    """Decodes all blocks: doc_id, start (ids before it), ids (little-endian unsigned 32-bit) of each document.

    Starts are sums over blocks: within a part by a window, over the parts by a window over one row a part.
    """
    sizes = blocks.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = sizes.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = blocks.select("part", "nth", (F.sum("ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("ids")).alias("inside"))
    starts = inside.join(parts, "part").select("part", "nth", (F.col("before") + F.col("inside")).alias("start"))
    shared = spark.sparkContext.broadcast(table.freq.astype(np.int64))
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(shared.value)
        for batch in small_batches(batches, 1):
            ids, documents = decode(batch.column(2)[0].as_py(), own)
            start = batch.column(0)[0].as_py() + np.cumsum(documents) - documents
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(documents)
            yield pa.RecordBatch.from_arrays([batch.column(1)[0].values, pa.array(start), pa.array([raw[b - 4 * n : b] for b, n in zip(ends.tolist(), documents.tolist())], pa.binary())], names=["doc_id", "start", "ids"])

    starts = F.broadcast(starts) if blocks.count() <= BROADCAST_BLOCKS else starts
    return blocks.join(starts, ["part", "nth"]).select("start", "doc_ids", "block").mapInArrow(run, f"doc_id {kind.simpleString()}, start bigint, ids binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all rows of ``documents`` and reads them back; null texts count as empty, null doc_ids come first, repeated rows are documents of their own."""
    blocks, table = write(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), Stage(spark, "rans"))
    return digests(read(spark, blocks, table))
