"""Histogram gradient-boosted trees over document statistics.

Statistics are computed for every whole text, in one pass. Trees are grown on binned statistics of a bounded
sample of labelled rows, on the driver; a fitted model is a handful of flat arrays, and scoring walks all trees of a
batch with numpy indexing, one step a level.

Null text counts as empty. Documents without a label, labels without a document and null labels are not learnt from.
With no labelled row at all every score is 0.5. Repeated ids stay separate rows. doc_id, lang, source and the labels
are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, crc32_mod, has_columns, raw_texts, small_batches

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "max_word_bytes", "short_words", "distinct_words", "top_word", "repeated_neighbours", "repeated_triples",
    "log_lines", "line_bytes", "duplicate_lines", "short_lines", "upper", "digits", "stops", "quotes", "marks", "symbols", "pipes", "brackets", "white", "control", "high",
    "entropy", "deflated", "shouted_words", "marked_words", "bulleted_lines", "ended_lines", "worst_line_symbols", "worst_line_upper",
)

_CLASSES = np.zeros((256, 11))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"\"'`", b"!", b"#*$%&@~^=+_/\\", b"|", b"()[]{}<>", b" \t\n\r\x0b\x0c", bytes({*range(32)} - {9, 10, 11, 12, 13}) + b"\x7f", bytes(range(128, 256)))):
    _CLASSES[list(_set), _k] = 1


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; any text, empty ones too, gives finite numbers."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _CLASSES / size
    p = counts[counts > 0] / size
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    triples = n - 2 - len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    neighbours = sum(a == b for a, b in zip(words, words[1:]))
    worst = np.array([[len(x) - len(x.translate(None, b"#*$%&|!~^=+_")), len(x) - len(x.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))] for x in lines if len(x) >= 20] or [[0, 0]])
    of = np.array([len(x) for x in lines if len(x) >= 20] or [1])
    some = text[:0].join(text[i : i + 8192] for i in range(0, len(text), 8192))
    return [
        np.log1p(len(text)), np.log1p(n), float(lengths.mean()), float(lengths.max()), float((lengths <= 3).mean()), len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), neighbours / max(1, n), triples / max(1, n),
        np.log1p(len(lines)), len(text) / m, 1 - len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m,
        shares[0], shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7], shares[8], shares[9], shares[10],
        float(-(p * np.log2(p)).sum()) if len(text) else 0.0, len(zlib.compress(some, 1)) / size, sum(map(bytes.isupper, words)) / max(1, n), sum(w[-1] in b"#*$%&|!" for w in words) / max(1, n),
        sum(x[:1] in (b"-", b"*", b"|") for x in lines) / m, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / m, float((worst[:, 0] / of).max()), float((worst[:, 1] / of).max()),
    ]


@dataclass
class Trees:
    """A forest as flat arrays: node k of tree t goes left to ``left``, right to ``left + 1``; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of all rows: every step moves all rows in all trees one level down."""
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                left = self.left[node]
                node = np.where(left < 0, node, left + (part[rows, self.feature[node]] > self.threshold[node]))
            out[at : at + 4096] = self.base + self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 4.0) -> Trees:
    """Boosts logistic loss. Level by level, gradient and curvature histograms of every node and feature come from
    one ``bincount`` a feature; the best split of each node is read off the cumulative histograms; ties go to the first
    feature and the lowest threshold."""
    n, width = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    if not n:
        return Trees(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.full(1, -1), np.zeros(1), 0.0, 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.int64)
    positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(positive / (1 - positive)))
    margin = np.full(n, base)
    roots, feature, threshold, left, value = [], [], [], [], []

    def add() -> int:
        for column, what in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
            column.append(what)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        level, at = [add()], np.zeros(n, np.int64)
        roots.append(level[0])
        done = np.zeros(n, np.int64)
        for d in range(depth + 1):
            k = len(level)
            alive = np.flatnonzero(at >= 0)
            gs, hs = (np.bincount(at[alive], weights=v[alive], minlength=k) for v in (g, h))
            best, split = np.full(k, 1e-9), np.full((k, 2), -1)
            if d < depth:
                for f in range(width):
                    key = at[alive] * bins + codes[f, alive]
                    gl, hl = (np.bincount(key, weights=v[alive], minlength=k * bins).reshape(k, bins).cumsum(axis=1)[:, :-1] for v in (g, h))
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - (gs**2 / (hs + smooth))[:, None]
                    gain[(hl < least / 4) | (hr < least / 4)] = 0
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(k), cut]
                    better = top > best + 1e-12
                    best[better] = top[better]
                    split[better] = np.stack([np.full(k, f), cut], axis=1)[better]
            nxt, where = [], np.full((k, 2), -1)
            for i, node in enumerate(level):
                if split[i, 0] < 0 or split[i, 1] >= len(edges[split[i, 0]]):
                    value[node] = rate * gs[i] / (hs[i] + smooth)
                else:
                    feature[node], threshold[node] = int(split[i, 0]), float(edges[split[i, 0]][split[i, 1]])
                    left[node] = add()
                    add()
                    where[i] = len(nxt), len(nxt) + 1
                    nxt += [left[node], left[node] + 1]
            owner = at[alive]
            ended = where[owner, 0] < 0
            done[alive[ended]] = np.array(level)[owner[ended]]
            right = codes[np.maximum(split[owner, 0], 0), alive] > split[owner, 1]
            at[alive] = np.where(ended, -1, np.where(right, where[owner, 1], where[owner, 0]))
            level = nxt
            if not level:
                break
        margin += np.array(value)[done]
    return Trees(*(np.array(v) for v in (roots, feature, threshold, left, value)), base, depth)


def _statistics_of(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """``extra`` (if any) and an array of the statistics for each row."""
    docs = has_columns(docs, [*([extra] if extra else []), "text"])
    schema = (f"{extra} {docs.schema[extra].dataType.simpleString()}, " if extra else "") + "x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("gbt")
        for batch in small_batches(batches):
            x = pa.array([list(map(float, statistics(t))) for t in raw_texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*([batch.column(0)] if extra else []), x], names=[*([extra] if extra else []), "x"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, **options) -> Trees:
    """Learns from at most ``max_rows`` labelled rows, the first by a hash of doc_id, so any corpus size costs the driver the same."""
    chosen = labels.select("doc_id", F.col(label).alias("y")).where("y is not null and doc_id is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = has_columns(docs, ["doc_id", "text"]).join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text for each sampled label
    got = _statistics_of(rows.select("y", "text"), "y").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows arrive in
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and a score in [0, 1] for every row."""
    docs = has_columns(docs, [*keep, "text"] if "text" not in keep else keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("gbt")
        for batch in small_batches(batches):
            x = np.array([statistics(t) for t in raw_texts(batch)], float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(model.score(x))], names=[*keep, "score"])

    return docs.mapInArrow(run, schema)


HELD_OUT = (4, 2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every row of ``documents`` with trees that learn from labels outside the held-out fold; null texts count as empty, repeated rows score alike."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc32_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    model = train(docs, labels.where(~held_out))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
