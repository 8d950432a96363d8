"""Token counts by greedy longest match, from a linear automaton.

The vocabulary's pieces form a trie. Each node knows how many pieces are surely emitted when its continuation fails
(``popped``) and where matching goes on (``failure``): the node spelling what those pieces leave over. One pass over a
word then yields the number of pieces without building any.

A word's first piece carries the vocabulary's start mark (a space in byte-level vocabularies), later pieces don't; the mark may be
a piece by itself where no longer one fits.
Words are runs of characters other than ASCII white space. A word that no sequence of greedy pieces spells counts as one
unknown token. Null and empty texts count 0; repeated ids stay separate rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import _byte_alphabet, default_vocabulary
from .common import has_columns, raw_texts, small_batches

_COUNTERS: dict[str, "PieceCounter"] = {}


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, without their mark: the bare mark is empty; pieces that go on) of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = {t["content"] for t in data.get("added_tokens", [])}
    back = {c: b for b, c in _byte_alphabet().items()}
    starts, inner = [], []
    for token in data["model"]["vocab"]:
        if token in added:
            continue
        raw = bytes(back[c] for c in token)
        if raw.startswith(b" "):
            starts.append(raw[1:])
        else:
            inner.append(raw)
    return starts, inner


class Automaton:
    """Nodes are numbers. Node 0 is the start of a word, node 1 its inside; ``go`` has each node's children by byte."""

    def __init__(self, starts: list[bytes], inner: list[bytes]):
        self.go: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, starts), (1, inner)):
            for p in pieces:
                node = root
                for b in p:
                    if b not in self.go[node]:
                        self.go[node][b] = len(self.go)
                        self.go.append({})
                        piece.append(False)
                    node = self.go[node][b]
                piece[node] = node > 1
        #: pieces emitted when a node's continuation fails, and the node of the rest; -1: nothing matches
        self.failure, self.popped = [-1] * len(self.go), [0] * len(self.go)
        if b"" in starts:
            self.failure[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, child in self.go[node].items():
                if piece[child]:
                    self.failure[child], self.popped[child] = 1, 1
                else:
                    popped, at = self.popped[node], self.failure[node]
                    while at >= 0 and b not in self.go[at]:
                        popped, at = popped + self.popped[at], self.failure[at]
                    if at >= 0:
                        self.failure[child], self.popped[child] = self.go[at][b], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        """The number of greedy pieces of a word; 1 for a word that they can't spell; 0 for none."""
        if not word:
            return 0
        go, failure, popped = self.go, self.failure, self.popped
        node, n = 0, 0
        for b in word:
            while b not in go[node]:
                n += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
            node = go[node][b]
        while node != 1:  # the end of the word fails everywhere
            n += popped[node]
            node = failure[node]
            if node < 0:
                return 1
        return n


class PieceCounter(dict):
    """Counts of words, kept for words seen before; ``limit`` bounds the memory."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__()
        self.count, self.limit = Automaton(*byte_level_pieces(path)).count, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = n = self.count(word)
        return n


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens and longest_word (most pieces of one word) of each row."""
    docs = has_columns(docs, ["doc_id", "text"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint, longest_word bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in small_batches(batches):
            each = [list(map(known.__getitem__, t.split())) for t in raw_texts(batch)]
            columns = [list(map(len, each)), list(map(sum, each)), [max(x, default=0) for x in each]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "longest_word"])

    return docs.mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every row of ``documents`` with the byte-level vocabulary; null and empty texts count 0."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
