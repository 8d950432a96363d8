"""Packing of documents into sequences by linear grouping.

A document's ids are cut into pieces of at most ``size`` ids; only its first piece may be shorter. Full pieces are
sequences of their own. The rest is bin packing over at most ``size - 1`` different lengths, so the number of pieces of
each length says all: it is counted on the cluster and the plan is made from these counts alone, at any corpus size.

1. Large lengths are put into groups of (nearly) equal cardinality and rounded up to their group's longest.
2. The few rounded sizes are packed by configurations (multisets that fit a sequence); a linear programme says how often each
   is used, and its columns come from a knapsack.
3. Actual pieces take the places of rounded ones, longest first, which leaves slack.
4. Small pieces go by best fit, longest first, into the slack, then into new sequences.

The plan is a list of runs (so many sequences with the same contents). Pieces of one length are ranked on the cluster and
find their place by rank. Null text counts as empty: its end id alone. Repeated ids are packed once for each row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import cached_bpe, default_vocabulary
from .common import Stage, has_columns

END_ID = 2
SIZE = 1024


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, part and nth (its place in its task's output)."""
    docs = has_columns(docs, ["doc_id", "text"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(vocabulary)
        for batch in batches:
            for at, data, bounds in bpe.encode_column(batch.column(1), end_id):
                sizes = np.diff(bounds)
                many = -(-sizes // size)
                rows = np.repeat(np.arange(len(sizes)), many)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                first = (sizes - 1) % size + 1
                start = np.where(nth > 0, first[rows] + (nth - 1) * size, 0)
                length = np.where(nth > 0, size, first[rows])
                raw = memoryview(data.astype("<u4")).cast("B")
                begin = 4 * (bounds[rows] + start)
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + rows)), pa.array(nth, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crcs))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, schema)


def _configuration(sizes: list[int], left: list[int], size: int, first: int) -> list[int]:
    """How many of each rounded size join ``first`` (an index) so that the sequence is as full as the sizes allow.

    A bounded knapsack over reachable totals; among equally full ones that found from longer sizes first.
    """
    room = size - sizes[first]
    reach: list[tuple[int, int] | None] = [None] * (room + 1)  # (size index, previous total)
    used = [0] * (room + 1)
    done = np.zeros(room + 1, bool)
    done[0] = True
    for i, s in enumerate(sizes):
        most = left[i] - (i == first)
        if most <= 0 or s > room:
            continue
        used = [0] * (room + 1)
        for total in range(s, room + 1):
            if not done[total] and done[total - s] and used[total - s] < most:
                done[total], reach[total], used[total] = True, (i, total - s), used[total - s] + 1
    total = int(np.flatnonzero(done)[-1])
    counts = [0] * len(sizes)
    counts[first] = 1
    while total:
        i, total = reach[total]
        counts[i] += 1
    return counts


def optimised(sizes: list[int], demand: list[int], size: int) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used: the linear programme of fewest sequences, rounded down.

    A revised simplex method over columns that a knapsack finds: a configuration enters while the sizes' prices say that it
    is worth more than one sequence. Work depends on the number of sizes alone.
    """
    m = len(sizes)
    if not m:
        return []
    s, each = np.array(sizes), np.array([size // n for n in sizes])
    columns, inverse, x = np.diag(each).astype(float), np.diag(1.0 / each), np.array(demand) / each
    most = size // int(s.min())
    room = np.arange(size + 1)[None, :] - s[:, None]
    for _ in range(60 * m):
        price = inverse.sum(axis=0)
        best, chosen = np.zeros(size + 1), []
        for _ in range(most):  # one item more in each round
            gain = np.where(room >= 0, price[:, None] + best[np.maximum(room, 0)], 0.0)
            pick = gain.argmax(axis=0)
            more = gain[pick, np.arange(size + 1)]
            chosen.append(np.where(more > best, pick, -1))
            best = np.maximum(more, best)
        if best[size] <= 1 + 1e-9:
            break
        column, left = np.zeros(m), size
        for picks in reversed(chosen):
            if picks[left] >= 0:
                column[picks[left]] += 1
                left -= s[picks[left]]
        step = inverse @ column
        ok = step > 1e-9
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(columns[:, k].astype(int).tolist(), int(x[k] + 1e-6)) for k in range(m) if x[k] >= 1 - 1e-6]


def plan(counts: np.ndarray, size: int = SIZE, large: float = 1 / 4, groups: int = 256) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of (number of sequences, [(length, how many in each)]) for ``counts[length]`` pieces of each length.

    Work depends on ``size`` and ``groups`` alone, not on the number of pieces.
    """
    counts = np.array(counts, dtype=np.int64)
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    if counts[size]:
        runs.append((int(counts[size]), [(size, 1)]))
    lengths = [int(n) for n in np.flatnonzero(counts[:size])[::-1] if n]
    big = [n for n in lengths if n > size * large]
    # 1. groups of equal cardinality, longest first; each is rounded up to its longest
    total, done, members = sum(int(counts[n]) for n in big), 0, defaultdict(list)
    for n in big:
        members[min(groups - 1, done * groups // max(1, total))].append(n)
        done += int(counts[n])
    sizes = [m[0] for m in members.values()]
    queues = [[[n, int(counts[n])] for n in m] for m in members.values()]
    left = [sum(c for _, c in q) for q in queues]
    open_runs: list[list] = []  # [number, contents, room]
    # 2. and 3. whole batches of one configuration; actual lengths are drawn from their groups, longest first

    def use(config: list[int], times: int) -> None:
        times = min([times, *(left[j] // c for j, c in enumerate(config) if c)])
        if not times:
            return
        for j, c in enumerate(config):
            left[j] -= c * times
        slots = [j for j, c in enumerate(config) for _ in range(c)]
        drawn = []  # a list of (length, number) runs for each place in the configuration
        for j in slots:
            need, got = times, []
            while need:
                n, have = queues[j][0]
                take = min(need, have)
                got.append((n, take))
                queues[j][0][1] -= take
                need -= take
                if not queues[j][0][1]:
                    queues[j].pop(0)
            drawn.append(got)
        bounds = sorted({0, *(int(x) for got in drawn for x in np.cumsum([c for _, c in got]))})
        for a, b in zip(bounds, bounds[1:]):
            contents = []
            for got in drawn:
                at = 0
                for n, c in got:
                    if at <= a < at + c:
                        contents.append(n)
                    at += c
            open_runs.append([b - a, contents, size - sum(contents)])

    for config, times in optimised(sizes, left, size):
        use(config, times)
    for i in range(len(sizes)):  # what rounding down has left, a few sequences for each size
        while left[i]:
            use(_configuration(sizes, left, size, i), total)
    # 4. best fit of the small ones, longest first: the least room that takes the piece
    by_room: dict[int, list[list]] = defaultdict(list)
    for r in open_runs:
        by_room[r[2]].append(r)
    for n in (n for n in lengths if n <= size * large):
        need = int(counts[n])
        while need:
            room = next((r for r in range(n, size) if by_room.get(r)), None)
            if room is None:
                fit = size // n
                full, rest = divmod(need, fit)
                for number, each in ((full, fit), (min(rest, 1), rest)):
                    if number:
                        by_room[size - each * n].append([number, [n] * each, size - each * n])
                break
            run = by_room[room].pop()
            if run[0] > need:
                by_room[room].append([run[0] - need, list(run[1]), room])
                run[0] = need
            need -= run[0]
            by_room[room - n].append([run[0], [*run[1], n], room - n])
    for some in by_room.values():
        for number, contents, _ in some:
            merged: dict[int, int] = {}
            for n in sorted(contents, reverse=True):
                merged[n] = merged.get(n, 0) + 1
            runs.append((int(number), list(merged.items())))
    return runs


class Places:
    """Finds the sequence and offset of the piece with a given rank among those of its length."""

    def __init__(self, runs: list[tuple[int, list[tuple[int, int]]]]):
        found = defaultdict(list)
        sequence, taken = 0, defaultdict(int)
        for number, contents in runs:
            offset = 0
            for n, each in contents:
                found[n].append((taken[n], sequence, each, offset))
                taken[n] += number * each
                offset += n * each
            sequence += number
        self.table = {n: np.array(v, dtype=np.int64).T for n, v in found.items()}
        self.sequences = sequence

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, each, offset = self.table[length]
        k = np.searchsorted(first, ranks, side="right") - 1
        inside = ranks - first[k]
        return sequence[k] + inside // each[k], offset[k] + inside % each[k] * length


def pack(spark: SparkSession, table: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns doc_id, piece, length and others).

    Ranks within a length come from counts of each (slice, length): rows are dealt into slices by a hash, so a length
    that a third of the pieces share is spread over all of them. The counts (slices times lengths) become cumulative
    on the cluster and meet their slice's rows as marker rows; only ``size`` totals reach the driver, for the plan.
    """
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = table.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(slices)).cast("int"))
    counts = keyed.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    totals = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        totals[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(plan(totals, size)))  # a few thousand runs at most
    markers = counts.select("length", "_slice", (F.sum("n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("n")).alias("_first"))
    both = keyed.unionByName(markers, allowMissingColumns=True)
    ranked = both.repartition(slices, "_slice").sortWithinPartitions("_slice", "length", F.col("_first").asc_nulls_last(), "doc_id", "piece")
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0  # the rank of the next row; a marker stands before the rows of each (slice, length)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            first = column("_first")
            real = first.is_null().to_numpy(zero_copy_only=False)
            marks = first.fill_null(0).to_numpy()
            lengths = column("length").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            cuts = [0, *np.flatnonzero(~real), len(lengths)]
            for a, b in zip(cuts, cuts[1:]):
                if a < len(lengths) and not real[a]:
                    at, a = int(marks[a]), a + 1
                if b > a:
                    sequence[a:b], offset[a:b] = places.value.of(int(lengths[a]), at + np.arange(b - a))
                    at += b - a
            out = pa.RecordBatch.from_arrays([*map(column, names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])
            yield out.filter(pa.array(real))

    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", sequence_id bigint, offset bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    stage = Stage(spark, "packing")
    return pack(spark, stage.table(pieces(docs, vocabulary, size), "pieces"), size)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of ``documents``; null texts count as empty, repeated rows are packed as often as they occur."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
