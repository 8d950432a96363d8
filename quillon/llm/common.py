"""Shared pieces: word splitting, stable hashing and tables staged in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; a temporary one where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _OWN_FOLDER[0]


class Stage:
    """Tables written once into the shared folder and reread: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table which no later frame reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def has_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[df[n] for n in names])


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    column = batch.column(batch.schema.get_field_index(name))
    return [t or "" for t in column.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Bounds what a Python step holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; ``limit`` bounds the memory."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


#: What operators keep in this process between tasks: by operator, what empties it.
_KEPT: dict[str, Callable[[], None]] = {}


def alone(owner: str, empty: Callable[[], None] | None = None) -> None:
    """Empties what other operators kept in this process, as Python workers are reused by the next one; ``empty`` is for what the owner is about to keep."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        _KEPT.pop(k)()
    if others:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)
    if empty:
        _KEPT[owner] = empty


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit integers."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` word hashes; of the whole sequence if it is shorter; none for no words."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = mix64(words[: n - width + 1])
    for k in range(1, width):
        out = mix64(out ^ (words[k : n - width + 1 + k] * np.uint64(2 * k + 1) + np.uint64(k)))
    return out


def crc32_mod(column: str, modulus: int) -> F.Column:
    """crc32 of a column's text modulo a number; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))
