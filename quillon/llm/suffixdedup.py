"""Removes every byte covered by a ``WIDTH``-byte string that also starts elsewhere in the corpus.

1. Every window of ``WIDTH`` bytes is anchored at the ``GRAM``-byte string with the smallest hash inside it (the leftmost
   of equals), so equal windows have equal anchors at equal places. Windows in a row with one anchor form a region.
2. Regions are counted by anchor and content. The windows of a region that occurs twice repeat as a whole; a region whose
   anchor no other region has is unique. Only the contents that share an anchor with other contents remain.
3. The remaining contents go into shards by anchor. A shard is put into suffix order by induced sorting (``induced.py``);
   neighbouring windows with ``WIDTH`` equal bytes repeat. Contents of an anchor with more than ``SPLIT`` of them are dealt over several shards,
   which then also report one fingerprint for each of their different windows; fingerprints seen in two shards repeat.
4. Runs of repeated windows are merged within each document and cut out.

Common prefixes are compared directly, byte for byte, between neighbours of the suffix order instead of being carried along.
Null text counts as empty; texts below ``WIDTH`` bytes keep all bytes. Rows with the same doc_id and text are different
places (each repeats the other) and get the same result. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, has_columns, raw_texts, small_batches
from .induced import common_prefix_reaches, suffix_order

WIDTH, GRAM = 400, 128
SHARD_BYTES = 2_000_000
#: An anchor with more contents (about 4 MB of them, twice a shard; sorting takes some 40 bytes for each) is dealt over several shards.
SPLIT = 7000
BROADCAST_ROWS = 500_000
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 2**64)
_BYTES = np.random.default_rng(400).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def regions(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first and last window) of each region of a text of at least ``width`` bytes."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    m, w = n - gram + 1, width - gram + 1
    h = (sums[gram:] - sums[:m]) * down[:m]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    blocks = -(-m // w)
    key = np.full(blocks * w, 2**64 - 1, np.uint64)
    key[:m] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    key = key.reshape(blocks, w)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    p = n - width + 1
    anchor = (np.minimum(right[:p], left[w - 1 : w - 1 + p]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cut])
    return h[anchor[first]], first, np.concatenate([cut - 1, [p - 1]])


def _occurrences(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """anchor, content (two halves of its fingerprint), doc_id, _th, first, last of every region."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, 128):
            rows, anchors, prints, firsts, lasts = [], [], [], [], []
            for k, text in enumerate(raw_texts(batch)):
                if len(text) < width:
                    continue
                anchor, first, last = regions(np.frombuffer(text, np.uint8), width, gram)
                view = memoryview(text)
                prints += [xxhash.xxh3_128_digest(view[a : b + width]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                rows.append(np.full(len(first), k))
                anchors.append(anchor)
                firsts.append(first)
                lasts.append(last)
            if rows:
                at = pa.array(np.concatenate(rows))
                halves = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(anchors).view(np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(1).take(at),
                    pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(lasts), pa.int32()),
                ], names=["anchor", "c1", "c2", "doc_id", "_th", "first", "last"])

    return docs.select("doc_id", "_th", "text").mapInArrow(run, f"anchor bigint, c1 bigint, c2 bigint, doc_id {kind}, _th bigint, first int, last int")


def _sort_shards(rows: DataFrame, width: int) -> DataFrame:
    """Sorts each shard; a row for each run of repeated windows of a content (region, at, until), and for shards that
    share their anchors a row for each different window (print1, print2; at is its first place)."""

    def shard(ids: list, texts: list[bytes], split: bool) -> Iterator[pa.RecordBatch]:
        import xxhash

        data = np.frombuffer(b"\0".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = ends - [len(t) for t in texts]
        symbols = data.astype(np.int16) + 1
        symbols[ends[:-1]] = 0
        order = suffix_order(symbols, 257, width)
        owner = np.searchsorted(ends, order, side="left")
        inside = np.minimum(owner, len(texts) - 1)
        window = (owner < len(texts)) & (order + width <= ends[inside])
        order, owner = order[window], owner[window]
        equal = common_prefix_reaches(data, order[:-1], order[1:], width)
        repeated = np.zeros(len(order), bool)
        repeated[:-1] |= equal
        repeated[1:] |= equal
        flags = np.zeros(len(data) + 1, bool)
        flags[order[repeated]] = True
        # runs of repeated windows never go on into the next content: the last bytes of a content start no window
        step = np.diff(flags.astype(np.int8), prepend=0)
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
        own = np.searchsorted(ends, a, side="left")
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in own.tolist()], pa.int64()), pa.array(a - starts[own], pa.int32()), pa.array(b - starts[own], pa.int32()), none, none], names=["region", "at", "until", "p1", "p2"])
        if split:
            heads = np.concatenate([[True], ~equal])[: len(order)]
            raw = data.tobytes()
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[p : p + width]) for p in order[heads].tolist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in owner[heads].tolist()], pa.int64()), pa.array(order[heads] - starts[owner[heads]], pa.int32()), pa.nulls(len(prints), pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["region", "at", "until", "p1", "p2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, split = None, [], [], False
        for batch in small_batches(batches, 512):
            for s, sp, i, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != now:
                    if texts:
                        yield from shard(ids, texts, split)
                    now, ids, texts = s, [], []
                split = sp
                ids.append(i)
                texts.append(t)
        if texts:
            yield from shard(ids, texts, split)

    return rows.mapInArrow(run, "region bigint, at int, until int, p1 bigint, p2 bigint")


def repeated_spans(spark: SparkSession, docs: DataFrame, width: int = WIDTH, gram: int = GRAM, split: int = SPLIT, name: str = "suffixes") -> DataFrame:
    """doc_id, _th (hash of the text), spans: the runs [first byte, last byte) to remove of each document that has any."""
    stage = Stage(spark, name)
    docs = has_columns(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text"))
    found = stage.table(_occurrences(docs, width, gram), "occurrences")
    content = ["anchor", "c1", "c2"]
    counts = stage.table(found.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_th", "first", "last")).alias("head")), "counts")
    whole = found.join(counts.where("n > 1").select(*content), content).select("doc_id", "_th", F.col("first").alias("a"), (F.col("last") + width).alias("b"))
    contested = counts.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    rows = counts.join(contested, "anchor").select(*content, "n", "contents", "head.*")
    rows = stage.table(rows.withColumn("region", F.xxhash64(*content)), "contested")
    total = rows.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + width + 1), F.lit(0)).alias("t")).first()["t"]
    shards = max(1, -(-total // SHARD_BYTES))
    piece = F.when(F.col("contents") > split, F.pmod(F.col("region"), F.ceil(F.col("contents") / split))).otherwise(0)
    place = F.pmod(F.xxhash64("anchor", piece), F.lit(shards)) + F.when(F.col("contents") > split, F.lit(shards)).otherwise(0)
    wanted = rows.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_hash"), "first", "last", "region", place.alias("shard"), (F.col("contents") > split).alias("split"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(wanted, F.expr("doc_id <=> _id AND _th = _hash")).select("shard", "split", "region", F.expr(f"substring(CAST(text AS binary), first + 1, last - first + {width})").alias("body"))
    dealt = texts.repartition(2 * shards, "shard").sortWithinPartitions("shard", "region")
    sorted_rows = stage.table(_sort_shards(_different(dealt), width), "sorted")
    runs = sorted_rows.where("until is not null").select("region", "at", "until")
    prints = sorted_rows.where("until is null")
    again = prints.groupBy("p1", "p2").agg(F.count("*").alias("n")).where("n > 1").select("p1", "p2")
    runs = runs.unionByName(prints.join(again, ["p1", "p2"]).select("region", "at", F.col("at").alias("until")))
    some = rows.where("n = 1").select("region", "doc_id", "_th", "first").join(runs, "region").select("doc_id", "_th", (F.col("first") + F.col("at")).alias("a"), (F.col("first") + F.col("until") + width).alias("b"))
    spans = whole.unionByName(some).groupBy("doc_id", "_th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return spans


def _different(dealt: DataFrame) -> DataFrame:
    """Drops a content that came twice because its row stands twice in the table (neighbours in the sorted shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            keep = [k != p for k, p in zip(keys, [last, *keys[:-1]])]
            if keys:
                last = keys[-1]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema)


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes; adjacent ones are one."""
    out: list[list[int]] = []
    for s in spans or []:
        a, b = s["a"], min(s["b"], size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    spans = repeated_spans(spark, docs, width, gram, split).select(F.col("doc_id").alias("_id"), F.col("_th").alias("_hash"), "spans")
    docs = has_columns(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_th", F.xxhash64("text"))
    rows = docs.join(spans, F.expr("doc_id <=> _id AND _th = _hash"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            size, removed, n, kept = [], [], [], []
            for text, some in zip(raw_texts(batch), batch.column(2).to_pylist(), strict=True):
                cuts = merged(some, len(text))
                edges = [0, *(x for c in cuts for x in c), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                size.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                n.append(len(cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, n)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every row of ``documents``; null texts count as empty, repeated rows count as different places of the same bytes."""
    out = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
