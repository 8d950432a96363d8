"""Text sources and sinks of studies: trial logs, shards, exclusive folders, manifests."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TRIALS = "trial_id int, category string, description string, values_evaluated string, selection_criterion string, selected_value string, counts_toward_dsr_trials string, notes string"
CANDIDATES = "trial_id int, candidate_label string, metric_type string, value double, evaluation_sample string, redundant_with string, source string, notes string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def counted_trials(log: DataFrame, column: str = "counts_toward_dsr_trials") -> DataFrame:
    """One row, n: trials whose text flag says true."""
    return log.where(F.lower(F.trim(column)) == "true").agg(F.count("*").alias("n"))


def candidates(table: DataFrame, metric_type: str, dedupe: bool = True) -> DataFrame:
    out = table.where(F.col("metric_type") == metric_type)
    return out.where(F.coalesce(F.trim("redundant_with"), F.lit("")) == "") if dedupe else out


def mixed_dates(column: str) -> F.Column:
    """Parses ISO dates, ISO stamps and month/day/year to a date; anything else is null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.col(column), F.lit(p))) for p in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy")))


def read_shards(spark: SparkSession, folder: str, schema: str, pattern: str = "shard_*.csv") -> DataFrame:
    return read_csv(spark, f"{folder}/{pattern}", schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_shards(spark: SparkSession, folder: str, schema: str, to: str, pattern: str = "shard_*.csv", delete: bool = True) -> DataFrame:
    """All shards as one new table, reread from ``to``; the shards go only after it holds as many rows as they do.

    Files are listed and deleted through the file system that owns ``folder``, so remote paths work.
    """
    shards = read_shards(spark, folder, schema, pattern)
    write_new(shards, to, form="parquet")
    merged = spark.read.parquet(to)
    if merged.count() != shards.count():
        raise ValueError(f"{to} doesn't hold the rows of {folder}/{pattern}")
    if delete:
        glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        files = glob.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(glob):
            files.delete(found.getPath(), False)
    return merged


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _OWN_FOLDER[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written into the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, **conditions: F.Column) -> DataFrame:
    """Raises with the names of the aggregate conditions that don't hold; all are evaluated in one pass."""
    row = df.agg(*(c.alias(n) for n, c in conditions.items())).first()
    if failed := [n for n in conditions if not row[n]]:
        raise ValueError(f"failed: {', '.join(failed)}")
    return df


def checked_write(df: DataFrame, path: str, form: str = "parquet", **conditions: F.Column) -> DataFrame:
    """Writes and checks in the same job: aggregates are observed while the rows pass. The table, read again, if all conditions hold; else
    an error with the names of those that don't, and nothing is left at ``path``, which must not exist yet.

    The rows go to a folder beside it, which takes its name after the check.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, aside = place.getFileSystem(spark._jsc.hadoopConfiguration()), f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    if files.exists(place):
        raise FileExistsError(path)
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in conditions.items())).write.option("header", True).format(form).save(aside)
    here = spark._jvm.org.apache.hadoop.fs.Path(aside)
    if failed := [n for n, ok in seen.get.items() if not ok]:
        files.delete(here, True)
        raise ValueError(f"failed: {', '.join(sorted(failed))}")
    if not files.rename(here, place):
        raise FileExistsError(path)
    return spark.read.schema(df.schema).option("header", True).format(form).load(path)


def write_new(df: DataFrame, path: str, by: list[str] | None = None, form: str = "csv") -> None:
    """Writes to a folder that must not exist yet."""
    writer = df.write.mode("errorifexists").option("header", True)
    (writer.partitionBy(*by) if by else writer).format(form).save(path)


def fixed_text(column: str, form: str = "%.12f") -> F.Column:
    """A number as text of fixed precision, for exports alone."""
    return F.format_string(form, F.col(column))


def verified_cache(spark: SparkSession, path: str, build, check) -> DataFrame:
    """Reads a result written before, if its check passes; else builds, writes and reads it."""
    try:
        found = spark.read.parquet(path)
        if check(found):
            return found
    except pyspark.errors.AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_arrays(path: str, **arrays: np.ndarray) -> None:
    np.savez_compressed(path, **arrays)


def load_arrays(path: str) -> dict[str, np.ndarray]:
    with np.load(path, allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a text table; more than ``limit`` rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = [df.columns, ["---"] * len(df.columns), *([f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(path: str, files: list[str], settings: dict) -> dict:
    """Code state, versions, settings and checksums of a run, written as JSON."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=False).stdout.strip()
    out = {"commit": git("rev-parse", "HEAD"), "clean": not git("status", "--porcelain"), "python": platform.python_version(), "spark": pyspark.__version__, "numpy": np.__version__, "settings": settings, "files": {f: file_sha256(f) for f in sorted(files)}}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True))
    return out
