"""MinHash near-duplicates by an LSH forest.

Documents are sets of word shingles. Equal sets become one representative, which stands in ``TREES`` sorted orders of its signature.

1. Rows that share the first ``SHALLOW`` values of an order form a region; others have no neighbour there. In each order a row's
   candidates are its neighbours, with which it shares the longest prefix: deep in crowded regions, shallow in thin ones. A
   region that outgrows ``REGION`` rows is cut where neighbours share the shortest prefix. Besides, every row meets its region's hub,
   the row closest to the values that most rows have (the likely original of near copies). The best neighbour and the best hub of
   all orders are confirmed on the full sets and joined into components: two pairs a row, however large its region.
2. What is left are links between rows of different components that share ``DEPTH`` values of an order. Where a region has several
   components, the rows outside its largest one and all its rows are dealt into blocks. Each pair of blocks is one group of bounded
   size, which compares rows of different components in the first order that they share and marks those that may have a link: first
   by the signatures at hand, then, among the marked rows, by signatures of ``FINE`` values. What is left has the full sets at hand and
   gives back the links that join components, fewer than their rows. No pair is written for later. The comparisons, not the rows, grow
   with the square of those that resemble each other without a link.

A pair of Jaccard similarity s shares ``DEPTH`` values in one of 20 orders at least with probability 1 - (1 - s^4)^20: 0.9999996 at
0.85. A pair is passed over if its fine signatures lie 4.75 standard errors below the threshold, or those at hand 7.

Null and empty texts have no shingle and are linked with nothing. Fewer words than the shingle width make one shingle. Rows that
repeat a doc_id are one document: a link of either holds for both. Null doc_ids stay alone. Ids may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Stage, WordHashes, alone, has_columns, raw_texts, shingle_hashes, small_batches

TREES, SHALLOW, DEPTH = 20, 3, 4
VALUES = TREES * DEPTH
#: Rows of a region that are held at once, and rows of one side of a block of pairs.
REGION, SIDE = 2048, 1024
#: More values, for rows whose regions stay mixed: they tell apart similarities just below the threshold.
FINE = 1024
_MULTIPLIERS = np.random.default_rng(20_240_501).integers(1, 2**63, VALUES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES: list[WordHashes] = []
#: Up to so many ids are broadcast as a filter; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; A-Z is lower-cased, words end at ASCII white space."""
    if not _HASHES:
        alone("neardup", _HASHES.clear)
        _HASHES.append(WordHashes())
    words = text.lower().split()
    return np.unique(shingle_hashes(np.fromiter(map(_HASHES[0].__getitem__, words), np.uint64, len(words)), width))


def signatures(sets: list[np.ndarray], fine: bool = False) -> np.ndarray:
    """MinHash values (rows of ``VALUES``, or of ``FINE`` others) of sets that aren't empty."""
    data = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    multipliers = _MULTIPLIERS[VALUES:] if fine else _MULTIPLIERS[:VALUES]
    out = np.empty((len(sets), len(multipliers)), np.uint64)
    for k, m in enumerate(multipliers):
        out[:, k] = np.minimum.reduceat(data * m, starts)
    return out


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, keys (one a tree: its first SHALLOW values), bytes (one of each value)."""
    docs = has_columns(docs, ["doc_id", "text"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, set_key binary, keys array<bigint>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, 256):
            sets = [shingle_set(t, width) for t in raw_texts(batch)]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, low = [None] * len(sets), [None] * len(sets)
            if full:
                sig = signatures([sets[k] for k in full])
                trees = np.zeros((len(full), TREES), np.uint64)
                for d in range(SHALLOW):
                    trees = (trees ^ sig[:, d::DEPTH]) * np.uint64(0x9E3779B97F4A7C15)
                    trees ^= trees >> np.uint64(29)
                trees = (trees ^ np.arange(TREES, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                tree_rows = trees.view(np.int64)
                low_rows = ((sig >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
                for row, k in enumerate(full):
                    keys[k], low[k] = tree_rows[row], low_rows[row].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary()),
            ], names=["doc_id", "n_shingles", "set_key", "keys", "bytes"])

    return docs.mapInArrow(run, schema)


def _regions(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(region, ids, signature bytes, whether it was cut) of a stream of (region, doc, bytes, order), sorted by region and order.

    A cut comes where neighbours share the shortest prefix, in the later half; the rows before a cut stand in both parts, so
    all neighbours meet.
    """
    held: list[tuple] = []
    cut = False

    def flush(n: int) -> tuple[int, np.ndarray, np.ndarray, bool]:
        part = held[:n]
        return part[0][0], np.array([x[1] for x in part]), np.frombuffer(b"".join(x[2] for x in part), np.uint8).reshape(n, -1), cut

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                if len(held) > 1:
                    yield flush(len(held))
                held, cut = [], False
            elif len(held) >= limit:
                order = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), -1)
                shared = np.where((order[1:] == order[:-1]).all(axis=1), VALUES, (order[1:] != order[:-1]).argmax(axis=1))
                at = len(held) // 2 + int(shared[len(held) // 2 :].argmin()) + 1
                cut = True
                yield flush(at)
                held = held[at - 1 :]
            held.append(row)
    if len(held) > 1:
        yield flush(len(held))


def _hub(sig: np.ndarray) -> tuple[int, int]:
    """(place, agreeing values) of the row that is closest to the most frequent byte of each value."""
    columns = np.arange(sig.shape[1])
    counts = np.bincount((sig + 256 * columns).ravel(), minlength=256 * len(columns)).reshape(-1, 256)
    agree = (sig == counts.argmax(axis=1)).sum(axis=1)
    return int(agree.argmax()), int(agree.max())


def _candidates(rows: DataFrame, least: int) -> DataFrame:
    """doc, other, agree, region, hub: in each region a row's best neighbour and its hub; for cut regions also each part's hub (doc null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, ids, sig, cut in _regions(batches, REGION):
            next_agree = (sig[1:] == sig[:-1]).sum(axis=1)
            left, right = np.concatenate([[-1], next_agree]), np.concatenate([next_agree, [-1]])
            place = np.arange(len(ids))
            other = np.where(left >= right, place - 1, place + 1)
            best = np.maximum(left, right)
            hub, share = _hub(sig)
            to_hub = (sig == sig[hub]).sum(axis=1)
            near, far = np.flatnonzero(best >= least), np.flatnonzero((to_hub >= least) & (place != hub))
            if len(ids) <= 3:
                far = far[:0]  # neighbours are all there is
            n = len(near) + len(far)
            more = [(None, int(ids[hub]), share, region, sig[hub].tobytes())] if cut else []
            yield pa.RecordBatch.from_arrays([
                pa.array([*ids[near].tolist(), *ids[far].tolist(), *(x[0] for x in more)], pa.int64()), pa.array([*ids[other[near]].tolist(), *([int(ids[hub])] * len(far)), *(x[1] for x in more)], pa.int64()),
                pa.array([*best[near].tolist(), *to_hub[far].tolist(), *(x[2] for x in more)], pa.int64()), pa.array([0] * len(near) + [1] * len(far) + [2] * len(more), pa.int32()),
                pa.array([None] * n + [x[3] for x in more], pa.int64()), pa.array([None] * n + [x[4] for x in more], pa.binary()),
            ], names=["doc", "other", "agree", "kind", "region", "hub"])

    ordered = rows.select("region", "doc", "bytes", "order").repartitionByRange("region", "order").sortWithinPartitions("region", "order", "doc")
    return ordered.mapInArrow(run, "doc bigint, other bigint, agree bigint, kind int, region bigint, hub binary")


def _to_hubs(rows: DataFrame, hubs: DataFrame, least: int) -> DataFrame:
    """doc, other, agree, kind: all rows of cut regions with the best hub of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8192):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 3))
            agree = (a == b).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree, pa.int64()), pa.array(np.ones(len(agree)), pa.int32())], names=["doc", "other", "agree", "kind"]).filter(keep)

    best = hubs.groupBy("region").agg(F.max(F.struct("agree", "other", "hub")).alias("h")).select("region", F.col("h.other").alias("other"), F.col("h.hub").alias("hub"))
    both = rows.select("region", "doc", "bytes").join(best, "region").where("doc <> other")
    return both.select("doc", "other", "bytes", "hub").mapInArrow(run, "doc bigint, other bigint, agree bigint, kind int")


class _Sets:
    """Component labels of a block's rows; merging relabels, so equal labels need no further comparison."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels.copy()

    def merge(self, x: int, y: int) -> None:
        self.labels[self.labels == self.labels[y]] = self.labels[x]


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


class _Block:
    """A pair of blocks: ``few`` rows outside a region's largest component and ``members`` of the region (doc, comp, keys, signature, set)."""

    def __init__(self, few: list, members: list):
        rows = {r[0]: r for r in [*few, *members]}
        at = {d: k for k, d in enumerate(rows)}
        self.names = list(rows)
        self.keys = np.frombuffer(b"".join(r[2] for r in rows.values()), np.int64).reshape(-1, TREES)
        self.signed = np.frombuffer(b"".join(r[3] for r in rows.values()), np.uint8).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows.values() if len(r) > 4]
        self.groups = _Sets(np.array([r[1] for r in rows.values()]))
        self.own, self.others = np.array([at[r[0]] for r in few]), np.array([at[r[0]] for r in members])

    def candidates(self, tree: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, agreeing values) of pairs of different components that may be linked and haven't met in an earlier order."""
        found: tuple[list, list, list] = ([], [], [])
        for x in self.own.tolist():
            y = self.others[self.groups.labels[self.others] != self.groups.labels[x]]
            y = y[~(self.keys[y, :tree] == self.keys[x, :tree]).any(axis=1)]
            agree = (self.signed[y] == self.signed[x]).sum(axis=1)
            y, agree = y[agree >= least], agree[agree >= least]
            for held, new in zip(found, (np.full(len(y), x), y, agree)):
                held.append(new)
        return tuple(map(np.concatenate, found))

    def links(self, tree: int, least: int, percent: int) -> list[tuple[int, int]]:
        """Confirmed pairs of ids that join components, the likeliest first."""
        x, y, n = self.candidates(tree, least)
        out = []
        for k in np.argsort(-n, kind="stable").tolist():
            a, b = int(x[k]), int(y[k])
            if self.groups.labels[a] != self.groups.labels[b] and reaches(self.sets[a], self.sets[b], percent):
                self.groups.merge(a, b)
                out.append((self.names[a], self.names[b]))
        return out


def _by_blocks(rows: DataFrame, more: DataFrame, of_block, schema: str) -> DataFrame:
    """``of_block(block, tree, deep)`` of each pair of blocks of mixed regions (tree, deep, doc, comp), whose rows get the columns of ``more`` by doc.

    Both sides are dealt into blocks of about ``SIDE`` rows, and each pair of blocks is one group, so a region of any size spreads.
    Rows are dealt out before they get their signatures and sets, which so move to their blocks once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        at = None
        for batch in small_batches(batches, 256):
            for tree, deep, piece, block, outside, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, deep, piece, block) != at:
                    if held[0] and held[1]:
                        yield from of_block(_Block(*held), *at[:2])
                    held, at = ([], []), (tree, deep, piece, block)
                held[0 if outside else 1].append(row)
        if held[0] and held[1]:
            yield from of_block(_Block(*held), *at[:2])

    region = ["tree", "deep"]
    sizes = rows.groupBy(*region, "comp").agg(F.count("*").alias("n")).groupBy(*region)
    sizes = sizes.agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n")).select(*region, F.col("m.comp").alias("main"), F.ceil(F.col("n") / SIDE).alias("pieces"), F.ceil((F.col("n") - F.col("m.n")) / SIDE).alias("blocks"))
    both = rows.join(sizes.where("blocks > 0"), region)
    piece, block = F.pmod(F.xxhash64("doc"), F.col("pieces")), F.pmod(F.xxhash64(F.lit(1), "doc"), F.col("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = both.select(*region, piece.alias("piece"), every("blocks").alias("block"), F.lit(False).alias("outside"), "doc", "comp")
    few = both.where("comp <> main").select(*region, every("pieces").alias("piece"), block.alias("block"), F.lit(True).alias("outside"), "doc", "comp")
    keys = *region, "piece", "block"
    dealt = few.unionByName(members).join(more, "doc").select(*keys, "outside", "doc", "comp", *(c for c in more.columns if c != "doc"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _joining_links(rows: DataFrame, signed: DataFrame, full_of, percent: int, stage: Stage) -> DataFrame:
    """a, b: confirmed links between components of mixed regions (tree, deep, doc, comp).

    ``signed`` (doc, keys, bytes) says which rows of a region may have a link at all. Only these get finer signatures and sets
    (``full_of`` of ids: doc, fine, members), and only the rows that the finer signatures leave move their sets.
    """

    def marks(least: int):
        def of_block(block: _Block, tree: int, deep: int) -> Iterator[pa.RecordBatch]:
            x, y, _ = block.candidates(tree, least)
            docs = [block.names[k] for k in np.unique(np.concatenate([x, y])).tolist()]
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(docs), pa.int32()), pa.array([deep] * len(docs), pa.int64()), pa.array(docs, pa.int64())], names=["tree", "deep", "doc"])

        return of_block

    least = least_agreement(FINE, percent)

    def links(block: _Block, tree: int, deep: int) -> Iterator[pa.RecordBatch]:
        if found := block.links(tree, least, percent):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    region_rows = "tree int, deep bigint, doc bigint"
    keys = signed.select("doc", "keys")
    marked = stage.table(_by_blocks(rows, signed, marks(least_agreement(VALUES, percent, 7)), region_rows).distinct(), "marked")
    full = stage.table(full_of(marked.select("doc").distinct()), "full", "uncompressed")
    rows = rows.join(marked, ["tree", "deep", "doc"])
    fine = keys.join(full.select("doc", "fine"), "doc")
    marked = stage.table(_by_blocks(rows, fine, marks(least), region_rows).distinct(), "marked_fine")
    rows = rows.join(marked, ["tree", "deep", "doc"])
    return stage.table(_by_blocks(rows, keys.join(full, "doc"), links, "a bigint, b bigint"), "joining")


def _near(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Ids alone, broadcast if they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def least_agreement(values: int, percent: int, errors: float = 4.75) -> int:
    """Equal values below which a pair can't plausibly reach the threshold: so many standard errors."""
    share = percent / 100
    return int(np.floor(values * (share - errors * np.sqrt(share * (1 - share) / values))))


def _texts_of(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, text of the rows with the given ids."""
    return has_columns(docs, ["doc_id", "text"]).join(_near(spark, ids), F.col("doc_id").cast("long") == F.col("doc"), "left_semi").select(F.col("doc_id").cast("long").alias("doc"), "text")


def _full(spark: SparkSession, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc, fine, members: the finer signatures and sets of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            sets = [shingle_set(t, width) for t in raw_texts(batch)]
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                low = ((signatures([sets[k] for k in full], True) >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([sets[k].tobytes() for k in full], pa.binary())], names=["doc", "fine", "members"])

    return _texts_of(spark, docs, ids).mapInArrow(run, "doc bigint, fine binary, members binary").dropDuplicates(["doc"])


def confirmed(spark: SparkSession, docs: DataFrame, pairs: DataFrame, width: int, percent: int, stage: Stage, name: str) -> DataFrame:
    """The pairs whose full sets reach 100 * intersection >= percent * union."""
    ids = stage.table(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), f"{name}_ids")
    some = _texts_of(spark, docs, ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in raw_texts(batch)], pa.binary())], names=["doc", "members"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            keep = [reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = stage.table(some.mapInArrow(sets, "doc bigint, members binary"), f"{name}_sets", "uncompressed")
    both = pairs.join(members.select(F.col("doc").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("doc").alias("b"), F.col("members").alias("y")), "b")
    out = stage.table(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint").distinct(), f"{name}_links")
    stage.drop(f"{name}_sets")
    return out


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(doc, comp): the smallest id reachable, for every id with a link. Stars grow larger, then smaller, until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for k in range(64):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage.table(small.where("u <> v").distinct(), f"{name}_{k}")
        after = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("the components didn't settle")
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, name: str = "neardup") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of every row."""
    stage = Stage(spark, name)
    docs = has_columns(docs, ["doc_id", "text"])
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):  # numbers in the order of the ids stand for them
        ids = docs.where("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        ids = stage.table(ids.select("doc_id", F.monotonically_increasing_id().alias("_number")), "numbers")
        found = near_duplicates(spark, docs.join(ids, "doc_id", "left").select(F.col("_number").alias("doc_id"), "text"), width, percent, name)
        own, other = ids.select("doc_id", F.col("_number").alias("_own")), ids.select(F.col("doc_id").alias("component_id"), F.col("_number").alias("_other"))
        found = found.select(F.col("doc_id").alias("_own"), "n_shingles", F.col("component_id").alias("_other"))
        return found.join(own, "_own", "left").join(other, "_other", "left").select("doc_id", "n_shingles", "component_id")
    sketches = stage.table(_sketches(docs, width), "sketches")
    known = sketches.where("set_key is not null and doc_id is not null")
    heads = known.groupBy("set_key").agg(F.min("doc_id").alias("head"))
    heads = stage.table(heads, "heads")
    heads_of = heads.select("set_key", F.col("head").cast("long").alias("doc"))
    reps = known.join(heads, "set_key").where("doc_id = head").dropDuplicates(["set_key"]).select(F.col("doc_id").cast("long").alias("doc"), "keys", "bytes")
    reps = stage.table(reps, "reps")
    keys = reps.select("doc", F.posexplode("keys").alias("tree", "region"))
    shared = keys.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    rows = stage.table(keys.join(shared, "region"), "regions")
    # a row's order: the values after its tree's shallow prefix, then those before
    order = F.expr(f"concat(substring(bytes, {DEPTH} * tree + {SHALLOW} + 1, {VALUES}), substring(bytes, 1, {DEPTH} * tree + {SHALLOW}))")
    rows = rows.join(reps.select("doc", "bytes"), "doc").withColumn("order", order)
    least = least_agreement(VALUES, percent)
    found = stage.table(_candidates(rows, least), "candidates")
    hubs = stage.table(found.where("kind = 2"), "hubs")
    met = found.where("kind < 2").select("doc", "other", "agree", "kind").unionByName(_to_hubs(rows, hubs, least))
    best = met.groupBy("doc", "kind").agg(F.max(F.struct("agree", "other")).alias("m"))
    tried = best.select(F.least("doc", "m.other").alias("a"), F.greatest("doc", "m.other").alias("b")).distinct()
    links = confirmed(spark, docs, stage.table(tried, "tried"), width, percent, stage, "first")
    comps = components(links, stage, "first")
    # regions of DEPTH values that hold several components
    deep = F.xxhash64("region", F.expr(f"substring(bytes, {DEPTH} * tree + {SHALLOW} + 1, {DEPTH - SHALLOW})"))
    again = rows.select("doc", "tree", deep.alias("deep")).join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    mixed = again.groupBy("deep").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("deep")
    again = stage.table(again.join(mixed, "deep"), "mixed")
    deeps = again.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("tree", "deep"))).alias("d"))
    packed = F.expr(f"reduce(sequence(0, {TREES - 1}), X'', (a, t) -> concat(a, unhex(lpad(hex(coalesce(d[t], xxhash64(doc, t))), 16, '0'))))")
    signed = stage.table(deeps.select("doc", packed.alias("keys")).join(reps.select("doc", "bytes"), "doc"), "signed")
    new = _joining_links(again, signed, lambda ids: _full(spark, docs, ids, width), percent, stage)
    comps = components(comps.select(F.col("doc").alias("a"), F.col("comp").alias("b")).unionByName(new), stage, "second")
    found = sketches.select("doc_id", "n_shingles", "set_key").join(heads_of, "set_key", "left").join(comps, "doc", "left")
    kind = docs.schema["doc_id"].dataType
    return found.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc")).cast(kind), "doc_id").alias("component_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words, 85 per cent, all rows of ``documents``; a row is kept if it is its component's smallest id. Null ids are kept."""
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
