"""A log-bilinear language model, trained by noise-contrastive estimation.

The next token is predicted from a sum of context vectors, weighted by place. Every word has a vector: the most frequent ones a
unit of their own, all others (unknown words too) the unit of their last ``SUFFIX`` bytes, within which counts tell them apart.
Units grow with the vocabulary: as many as the square of its cube root, so a token's cost grows with the cube root. They stand in
classes of equal size by frequency, and P(word) = P(class) P(unit in class) P(word in unit); the first two are softmaxes of batched
matrix products, so probabilities are normalised over the known words and one unseen slot for each suffix unit.

Training takes ``ROUNDS`` rounds. A row's hash says its round and shard, and a shard's rows are sorted, so the input's partitions
make no difference but for rounding (the sums of a unit's rows are taken in their shards' order). In a round every shard runs noise-contrastive steps over its rows from the
last round's model; the results are averaged unit by unit, weighted by how often a shard met the unit. A shard has some
``SHARE`` tokens for each unit, so what moves, one row a shard and unit, stays below the corpus.

Word counts cover all training documents; the most frequent ``HEAD`` short words are broadcast, any other word's count is joined by a
shuffle. Null text counts as empty: its end token alone. Repeated ids are scored once for each row. Without any training token the
model gives a token the share of its unseen slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, crc32_mod, has_columns

#: Words with counts at hand in every task; their bytes are at most HEAD * LONGEST.
HEAD, LONGEST = 300_000, 48
#: The least and largest side of the square of units; the share of units for suffixes; the least count of a word with its own unit.
SIDES, SUFFIXES, LEAST = (32, 512), 1 / 4, 8
DIM, CONTEXT, SUFFIX = 16, 3, 3
ROUNDS, SHARE, LESSON = 3, 128, 1_000_000
#: Tokens whose outputs and whose predictions are computed at once, and bytes of text that are split at once.
BLOCK, CHUNK, SLICE_BYTES = 2048, 1 << 17, 4 << 20
END = b""
HELD_OUT = (5, 1)


def tokens(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: (first row, its different tokens, the place of each token among them, tokens of each row).

    Tokens are words in lower case (A-Z) and one end, the last of the different ones, after each row.
    """
    column = pc.fill_null(column.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(at, stop - at)))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        real = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)
        index = words.indices.to_numpy().astype(np.int64)
        keep = real[index] if len(index) else np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds - bounds[0]]  # white space at a text's edges leaves empty parts
        index = np.insert(index[keep], bounds[1:], len(words.dictionary))
        yield at, pa.concat_arrays([words.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), index, np.diff(bounds) + 1
        at = stop


def word_counts(docs: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """word (binary), c: partial counts a task, never more than about ``limit`` rows at once, then a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> list[pa.RecordBatch]:
            both = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])
            held.clear()
            return both.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            for _, words, index, _ in tokens(batch.column(0)):
                counts = np.bincount(index, minlength=len(words))
                some = np.flatnonzero(counts)
                held.append(pa.table({"word": words.take(pa.array(some)), "c": pa.array(counts[some], pa.int64())}))
                if sum(t.num_rows for t in held) > limit:
                    yield from out()
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """Which unit a word has. ``words`` are the head's in falling order of counts ``c``, the first ``own`` of them have units."""

    words: list[bytes]
    c: np.ndarray
    own: int
    side: int
    #: Log10 of the sum over a suffix unit's known words and unseen slot, from the first one on.
    within: np.ndarray

    def __post_init__(self) -> None:
        self.head: pa.Array | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"head": None}  # each task makes its own

    @property
    def suffixes(self) -> int:
        return self.side**2 - self.own

    def of(self, words: pa.Array, owned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ranks in the head or -1, units) of different words; if ``owned``, words without a unit of their own have no rank either, which is cheaper."""
        if self.head is None:
            self.head = pa.array(self.words, pa.binary())
        found = pc.fill_null(pc.index_in(words, self.head[: self.own] if owned else self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        units = found.copy()
        rare = np.flatnonzero((found < 0) | (found >= self.own))
        units[rare] = self.own + suffix_crc(words.take(pa.array(rare))) % self.suffixes
        return found, units

    def pad(self) -> int:
        return int(self.of(pa.array([END], pa.binary()))[1][0])


_CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)
_CRC_STEP = _CRC ^ _CRC[0]  # the table of crc32: what a byte adds


def suffix_crc(words: pa.Array) -> np.ndarray:
    """crc32 of each word's last ``SUFFIX`` bytes."""
    _, offsets, data = words.cast(pa.binary()).buffers()
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    sizes = np.minimum(np.diff(offsets), SUFFIX)
    starts = offsets[1:] - sizes
    out = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(SUFFIX):
        some = np.flatnonzero(sizes > k)
        crc = out[some]
        out[some] = _CRC_STEP[(crc ^ data[starts[some] + k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return (out ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def side_of(vocabulary: int) -> int:
    """The side of the square of units for a number of different training tokens."""
    return int(np.clip(round(vocabulary ** (1 / 3)), *SIDES))


@dataclass
class Model:
    """R: context vectors (units, dim); A: weights by place (context, dim); Q, b: vectors and biases of units, then of classes."""

    R: np.ndarray
    A: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    def hidden(self, past: list[np.ndarray]) -> np.ndarray:
        """Predictions before each token; ``past`` has the units one, two ... places before."""
        h = self.R.take(past[0], axis=0)
        h *= self.A[0]
        for k in range(1, CONTEXT):
            more = self.R.take(past[k], axis=0)
            more *= self.A[k]
            h += more
        return h

    def log_probabilities(self, units: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
        """Natural log of P(unit | past) of all tokens."""
        out = np.zeros(len(units), np.float64)
        past = contexts(units, first, pad)
        outputs = np.column_stack([self.Q, self.b])
        for at in range(0, len(units), CHUNK):
            some = slice(at, at + CHUNK)
            out[some] = self._some(units[some], self.hidden([x[some] for x in past]), outputs)
        return out

    def _some(self, units: np.ndarray, h: np.ndarray, outputs: np.ndarray) -> np.ndarray:
        n, per_class = len(self.R), per_class_of(len(self.R))
        kinds = units // per_class
        order = np.argsort(kinds.astype(np.int16), kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(kinds, minlength=n // per_class))])
        h = np.column_stack([h.take(order, axis=0), np.ones(len(h), np.float32)])  # the last column meets the biases
        units, kinds = units.take(order), kinds.take(order)
        logs = np.empty(len(units))
        for at in range(0, len(units), BLOCK):
            some = slice(at, at + BLOCK)
            logs[some] = _log_share(h[some], outputs[n:], kinds[some])
        for c in range(n // per_class):
            rows = slice(c * per_class, (c + 1) * per_class)
            for at in range(cuts[c], cuts[c + 1], BLOCK):
                some = slice(at, min(at + BLOCK, cuts[c + 1]))
                logs[some] += _log_share(h[some], outputs[rows], units[some] - c * per_class)
        out = np.empty(len(units))
        out[order] = logs
        return out


def per_class_of(units: int) -> int:
    return int(round(np.sqrt(units)))


def _log_share(h: np.ndarray, q: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of h q at one place of each row."""
    scores = h @ q.T
    own = scores[np.arange(len(scores)), which].astype(np.float64)
    if scores.max() < 60:  # no overflow
        total = np.exp(scores, out=scores) @ np.ones(len(q), np.float32)
        if total.min() > 1e-30:
            return own - np.log(total.astype(np.float64))
        scores = h @ q.T
    top = scores.max(axis=1)
    return own - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))


def contexts(units: np.ndarray, first: np.ndarray, pad: int) -> list[np.ndarray]:
    """The units one, two ... places before each token; ``pad`` before the text's start."""
    out = []
    for k in range(1, CONTEXT + 1):
        past = np.full(len(units), pad, units.dtype)
        past[k:] = units[:-k]
        past[first < k] = pad
        out.append(past)
    return out


def start(shares: np.ndarray) -> Model:
    """The common start: small random vectors and the logs of the shares, so the first model is the unigram one."""
    r = np.random.default_rng(11)
    n = len(shares)
    by_class = shares.reshape(-1, per_class_of(n)).sum(axis=1)
    bias = np.log(np.maximum(np.concatenate([shares, by_class]), 1e-12))
    return Model(r.standard_normal((n, DIM), np.float32) * np.float32(0.3), np.full((CONTEXT, DIM), 0.6, np.float32), r.standard_normal((n + len(by_class), DIM), np.float32) * np.float32(0.05), bias.astype(np.float32))


def _scatter(rows: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, sums of their values); rows are below ``most``."""
    order = np.argsort(rows.astype(np.uint16) if most <= 65536 else rows, kind="stable")  # a radix sort of short numbers
    sorted_rows = rows[order]
    at = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    values = values.take(order, axis=0)
    if values.dtype == np.float32 and not values.shape[1] % 2:  # two columns at once
        return sorted_rows[at], np.add.reduceat(values.view(np.complex64), at, axis=0).view(np.float32)
    return sorted_rows[at], np.add.reduceat(values, at, axis=0)


class Trainer:
    """Noise-contrastive steps with AdaGrad; units and classes are two sets of outputs over one prediction."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int, noise: int = 64, rate: float = 0.06):
        self.outputs = np.zeros((len(model.b), DIM + 2), np.float32)  # vector, bias and a zero, as pairs of columns are summed
        self.outputs[:, :DIM], self.outputs[:, DIM] = model.Q, model.b
        self.m = Model(model.R.copy(), model.A.copy(), self.outputs[:, :DIM], self.outputs[:, DIM])
        self.r = np.random.default_rng(seed)
        self.k, self.rate = noise, rate
        self.per_class = per_class_of(len(shares))
        by_class = shares.reshape(-1, self.per_class).sum(axis=1)
        self.sets = []
        for p, offset, k in ((shares, 0, noise), (by_class, len(shares), noise // 3)):
            p = np.maximum(p, 1e-9)
            p = p / p.sum()
            self.sets.append((np.cumsum(p), np.log(k * p).astype(np.float32), offset, k))
        self.gR, self.gA, self.g_outputs = (np.full(x.shape, 1e-3, np.float32) for x in (model.R, model.A, self.outputs))
        self.met = np.zeros(len(model.Q))

    def _apply(self, x: np.ndarray, g2: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        seen = g2.take(rows, axis=0)
        seen += grad * grad
        g2[rows] = seen
        new = x.take(rows, axis=0)
        new -= self.rate * grad / np.sqrt(seen)
        x[rows] = new

    def learn(self, units: np.ndarray, past: list[np.ndarray], size: int = 4096) -> None:
        """Steps over all tokens in a random order."""
        order = self.r.permutation(len(units))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            self.step(units.take(some), [x.take(some) for x in past])
        n = len(self.m.R)
        self.met[:n] += np.bincount(units, minlength=n)
        self.met[n:] += np.bincount(units // self.per_class, minlength=len(self.met) - n)

    def step(self, units: np.ndarray, past: list[np.ndarray]) -> None:
        m, n = self.m, len(units)
        vectors = [m.R.take(p, axis=0) for p in past]
        with_one = np.zeros((n, DIM + 2), np.float32)
        with_one[:, DIM] = 1  # meets the biases
        h = vectors[0] * m.A[0]
        for v, a in zip(vectors[1:], m.A[1:]):
            h += v * a
        with_one[:, :DIM] = h
        dh = np.zeros_like(with_one)
        scale = np.float32(64 / n)
        for (cumulative, log_noise, offset, k), y in zip(self.sets, (units, units // self.per_class)):
            drawn = np.minimum(np.searchsorted(cumulative, self.r.random(k)), len(cumulative) - 1)
            own, other = self.outputs.take(y + offset, axis=0), self.outputs.take(drawn + offset, axis=0)
            real = np.einsum("ij,ij->i", with_one, own) - log_noise.take(y)
            less = -other
            less[:, DIM] += log_noise[drawn]
            g_fake = with_one @ less.T
            g_real = -scale / (1 + np.exp(np.clip(real, -30, 30)))
            if g_fake.max() > 30:
                np.minimum(g_fake, 30, out=g_fake)
            np.exp(g_fake, out=g_fake)
            g_fake += 1
            np.divide(scale, g_fake, out=g_fake)
            own *= g_real[:, None]
            dh += own
            dh += g_fake @ other
            grads = np.empty((n + k, DIM + 2), np.float32)
            np.multiply(with_one, g_real[:, None], out=grads[:n])
            np.matmul(g_fake.T, with_one, out=grads[n:])
            rows, sums = _scatter(np.concatenate([y, drawn]), grads, len(cumulative))
            self._apply(self.outputs, self.g_outputs, rows + offset, sums)
        dh = dh[:, :DIM]
        rows, sums = _scatter(np.concatenate(past), np.concatenate([dh * a for a in m.A]), len(m.R))
        dA = np.stack([np.einsum("ij,ij->j", dh, v) for v in vectors])
        self._apply(m.R, self.gR, rows, sums)
        self._apply(m.A, self.gA, np.arange(CONTEXT), dA * np.float32(0.1 / 64))


def _places(sizes: np.ndarray) -> np.ndarray:
    """The place of each token in its row."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def train(spark: SparkSession, docs: DataFrame, units, shares: np.ndarray, n_tokens: int) -> Model:
    """``ROUNDS`` rounds over all rows of ``docs`` (columns doc_id, text); ``units`` is a broadcast of ``Units``."""
    n, width = len(shares), 2 * DIM + 2
    outputs = n + n // per_class_of(n)
    shards = max(1, round(n_tokens / ROUNDS / max(LESSON, SHARE * n)))
    model = start(shares)
    slot = F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards * ROUNDS))
    lessons = docs.select("text", "doc_id", slot.alias("slot"))

    def run_from(begin, nth: int):
        def batch_of(shard: int, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.full(len(rows), shard), pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], names=["unit", "shard", "sums"])

        def results(shard: int, trainer: Trainer) -> Iterator[pa.RecordBatch]:
            m, met = trainer.m, trainer.met
            some = np.flatnonzero(met)
            for at in range(0, len(some), 8192):
                part = some[at : at + 8192]
                rows, words = np.zeros((len(part), width)), part < n
                rows[:, :DIM], rows[:, DIM], rows[words, DIM + 1 : 2 * DIM + 1], rows[:, -1] = m.Q[part], m.b[part], m.R[part[words]], met[part]
                yield batch_of(shard, part, rows)
            rows = np.zeros((CONTEXT, width))
            rows[:, :DIM], rows[:, -1] = m.A, met.sum() / 2
            yield batch_of(shard, outputs + np.arange(CONTEXT), rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, trainer, pad = None, None, units.value.pad()
            for batch in batches:
                slots = batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if slots[a] != now:
                        if trainer is not None:
                            yield from results(now, trainer)
                        now = int(slots[a])
                        trainer = Trainer(begin.value, shares_of.value, now)
                    for _, words, index, sizes in tokens(batch.column(0).slice(a, b - a)):
                        y = units.value.of(words, owned=True)[1].take(index)
                        past = contexts(y, _places(sizes), pad)
                        trainer.learn(y, past)
            if trainer is not None:
                yield from results(now, trainer)

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
            x[:, :-1] *= x[:, -1:]
            rows, sums = _scatter(np.concatenate([rows, batch.column(0).to_numpy()]), np.concatenate([sums, x]), outputs + CONTEXT)
        for at in range(0, len(rows), 8192):
            x = sums[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([rows[at : at + 8192].astype(np.int32).tobytes()]), pa.array([(x[:, :-1] / x[:, -1:]).astype(np.float32).tobytes()])], names=["units", "means"])

    shares_of = spark.sparkContext.broadcast(shares)
    for nth in range(ROUNDS):
        begin = spark.sparkContext.broadcast(model)
        rows = lessons.where(F.col("slot") % ROUNDS == nth).repartition(shards, "slot").sortWithinPartitions("slot", F.xxhash64("doc_id", "text"), "text")
        met = rows.select("text", "slot").mapInArrow(run_from(begin, nth), "unit int, shard bigint, sums binary")
        means = met.repartition("unit").sortWithinPartitions("unit", "shard").mapInArrow(add, "units binary, means binary")
        model = Model(model.R.copy(), model.A.copy(), model.Q.copy(), model.b.copy())
        for row in means.collect():  # packed: one vector a unit
            at, x = np.frombuffer(row["units"], np.int32), np.frombuffer(row["means"], np.float32).reshape(-1, width - 1)
            words, places = at < n, at >= outputs
            model.A[at[places] - outputs] = x[places, :DIM]
            model.Q[at[~places]], model.b[at[~places]] = x[~places, :DIM], x[~places, DIM]
            model.R[at[words]] = x[words, DIM + 1 :]
    return model


def score(spark: SparkSession, docs: DataFrame, counts: DataFrame, units, model: Model, totals: dict, stage: Stage, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score, score of every row of ``docs`` (columns ``keep`` and text)."""
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    whole = float(np.log10(totals["N"] + 0.5 * (totals["V"] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        u, m = units.value, shared.value
        pad = u.pad()
        logs = np.append(np.log10(u.c + 0.5), 0.0)  # the last for words beyond the head, whose counts are joined
        inside = np.concatenate([np.zeros(u.own), u.within])
        row = TaskContext.get().partitionId() << 33
        names = ["_row", *keep, "_n_tokens", "_n_known", "_base", "_score", "_word", "_times"]
        for batch in batches:
            for first, words, index, sizes in tokens(batch.column(batch.schema.get_field_index("text"))):
                n = len(sizes)
                found, unit = u.of(words)
                y = unit.take(index)
                head = found.take(index)
                count = logs[head]
                scores = m.log_probabilities(y, _places(sizes), pad) / np.log(10) - inside[y] + np.where(y >= u.own, count, 0.0)
                starts = np.cumsum(sizes) - sizes
                rows = np.arange(row, row + n)
                row += n
                known = [batch.column(batch.schema.get_field_index(k)).slice(first, n) for k in keep]
                columns = [pa.array(rows), *known, pa.array(sizes), pa.array(np.add.reduceat((head >= 0).astype(np.int64), starts)), pa.array(np.add.reduceat(count, starts) - sizes * whole), pa.array(np.add.reduceat(scores, starts)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                beyond = np.flatnonzero(head < 0)
                if not len(beyond):
                    continue
                pair, times = np.unique(np.repeat(np.arange(n), sizes)[beyond] * len(words) + index[beyond], return_counts=True)
                for at in range(0, len(pair), 50_000):
                    some = pair[at : at + 50_000]
                    k = len(some)
                    columns = [pa.array(rows[some // len(words)]), *(pa.nulls(k, c.type) for c in known), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), words.take(pa.array(some % len(words))), pa.array(times[at : at + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    both = stage.table(docs.mapInArrow(run, f"_row bigint, {fields}, _n_tokens bigint, _n_known bigint, _base double, _score double, _word binary, _times bigint"), "scored")
    c = F.coalesce("c", F.lit(0))
    tail = both.where("_word is not null").select("_row", F.col("_word").alias("word"), F.col("_times").alias("times")).join(counts, "word", "left")
    tail = tail.groupBy("_row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("_more"))
    more = F.coalesce("_more", F.lit(0.0))
    out = both.where("_word is null").join(tail, "_row", "left")
    return out.select(*keep, F.col("_n_tokens").alias("n_tokens"), (F.col("_n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), (F.col("_base") + more).alias("base_score"), (F.col("_score") + more).alias("score"))


def head_of(counts: DataFrame, limit: int = HEAD) -> list:
    """At most ``limit`` short words with the largest counts, in falling order; of words with like counts a share that their hashes choose.

    The cut comes from a histogram of counts, so tasks send no words that aren't taken.
    """
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("size", F.floor(64 * F.log2("c"))).withColumn("lot", F.pmod(F.xxhash64("word"), F.lit(1024)))
    room, taken = limit, F.lit(False)
    for row in sorted(short.groupBy("size").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["size"]):  # some thousand sizes at most
        if row["n"] <= room:
            room, taken = room - row["n"], F.col("size") >= row["size"]
            continue
        lots = 0
        for lot in short.where(F.col("size") == row["size"]).groupBy("lot").agg(F.count("*").alias("n")).orderBy("lot").collect():  # 1,024 rows
            if lot["n"] > room:
                break
            room, lots = room - lot["n"], lot["lot"] + 1
        taken = taken | ((F.col("size") == row["size"]) & (F.col("lot") < lots))
        break
    return sorted(short.where(taken).select("word", "c").collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def language_model_scores(spark: SparkSession, docs: DataFrame, learn: F.Column, keep: list[str], name: str = "lm") -> tuple[DataFrame, dict]:
    """Learns from the rows where ``learn`` holds and scores all rows (columns ``keep``, n_tokens, n_known, base_score, score).

    Also returns the training totals: N and V (tokens and different ones), the ``Units`` and the ``Model``.
    """
    stage = Stage(spark, name)
    lessons = docs.where(learn)
    counts = stage.table(word_counts(lessons), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    totals = {"N": int(sums["N"]), "V": int(sums["V"])}
    top = head_of(counts)
    words, c = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.float64)
    side = side_of(totals["V"])
    own = min(int((c >= LEAST).sum()), int(side**2 * (1 - SUFFIXES)))
    n = side**2 - own
    key = F.when(F.octet_length("word") <= SUFFIX, F.col("word")).otherwise(F.expr(f"substring(word, -{SUFFIX})"))
    mass, kinds = np.zeros(n), np.zeros(n)
    for row in counts.groupBy((F.crc32(key) % n).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each suffix unit
        mass[row["k"]], kinds[row["k"]] = row["c"], row["v"]
    for w, times in zip(words[:own], c[:own], strict=True):  # these have units of their own
        k = zlib.crc32(w[-SUFFIX:]) % n
        mass[k], kinds[k] = mass[k] - times, kinds[k] - 1
    units = Units(words, c, own, side, np.log10(mass + 0.5 * (kinds + 1)))
    shares = np.concatenate([c[:own], mass + 0.5])
    shares /= shares.sum()
    shared = spark.sparkContext.broadcast(units)
    model = train(spark, lessons.select("doc_id", "text"), shared, shares, totals["N"])
    scores = score(spark, docs.select(*keep, "text"), counts, shared, model, totals, stage, keep)
    return scores, totals | {"units": units, "model": model}


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every row of ``documents`` with a model of the rows that aren't held out; one row out for each row, null text as empty."""
    docs = has_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"])
    held_out = crc32_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    scores, totals = language_model_scores(spark, docs, ~held_out, ["doc_id"])
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(totals["N"]).cast("long").alias("train_tokens"), "base_score", "score")
