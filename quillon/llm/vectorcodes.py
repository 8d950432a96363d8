"""Vector codes: product quantisation of integer vectors by weighted Lloyd rounds over distinct parts.

Components become floor(``SCALE`` * x). A vector is cut into ``PARTS`` equal consecutive parts; equal parts at one position are
folded into one distinct row with a weight, and each round assigns those rows alone. The codebooks (``PARTS`` x ``ENTRIES``
integer rows, a fixed size) go to the tasks; a task returns at most one sum and count for each entry, which Spark adds up. At the
end codes and errors of the distinct rows are joined back to the vectors.

Dropped rows: vector null, a null or non-finite component, or a length that no codebook has: not a positive multiple of ``PARTS``, or
another than that of the smallest remaining vec_id. Repeated rows count as often as they occur; ties of vec_id are ordered
by their components, null vec_ids come last. Fewer than ``ENTRIES`` rows give shorter codebooks, an empty table gives an empty one.
A component beyond +-2**21 raises an error, since sums of squares wouldn't fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, has_columns

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are held at once.
ROWS = 4096


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers) of the rows that are kept, whatever their length."""
    kept = has_columns(vectors, ["vec_id", "embedding", "label"]).where("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    whole = f"transform(embedding, x -> IF(abs(x) <= {2**21}, CAST(floor({SCALE}D * x) AS BIGINT), CAST(raise_error('a component is too large') AS BIGINT)))"
    return kept.where(F.expr(f"size(embedding) % {PARTS} = 0")).select("vec_id", "label", F.expr(whole).alias("v"))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower one) and its squared distance, both exact integers."""
    most = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * book.shape[1] < 2**53 else np.int64  # floats of that size are exact
    book = book.astype(kind)
    norms = (book * book).sum(axis=1)
    codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), ROWS):
        own = rows[at : at + ROWS].astype(kind)
        far = norms - 2 * (own @ book.T)
        best = far.argmin(axis=1)
        codes[at : at + ROWS] = best
        errors[at : at + ROWS] = far[np.arange(len(own)), best] + (own * own).sum(axis=1)
    return codes, errors


def first_books(vectors: DataFrame) -> np.ndarray:
    """(PARTS, entries, width): the parts of the smallest vec_ids; ``ENTRIES`` rows at most come to the driver."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    book = np.array([r["v"] for r in rows], np.int64)
    return np.ascontiguousarray(book.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one weighted round over the distinct rows (pos, part, weight)."""
    width = books.shape[2]

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for pdf in frames:
            for pos, own in pdf.groupby("pos"):
                rows, weights = np.stack(own["part"].to_numpy()), own["weight"].to_numpy()
                codes, _ = nearest(rows, books[pos])
                np.add.at(sums[pos], codes, rows * weights[:, None])
                np.add.at(counts[pos], codes, weights)
        pos, code = np.nonzero(counts)
        yield pd.DataFrame({"pos": pos.astype("int32"), "code": code.astype("int32"), "n": counts[pos, code], "s": list(sums[pos, code])})

    parts = distinct.mapInPandas(gather, "pos int, code int, n bigint, s array<bigint>")
    total = parts.groupBy("pos", "code").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[k]) for k in range(width))).alias("s"))
    out = books.copy()
    for r in total.collect():  # PARTS * ENTRIES rows at most
        out[r["pos"], r["code"]] = [v // r["n"] for v in r["s"]]
    return out


def encode(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS, name: str = "codes") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes (0-based, one a part), error of every kept row; the final codebooks)."""
    stage = Stage(spark, name)
    rows = stage.table(integer_rows(vectors).withColumn("row", F.monotonically_increasing_id()), "rows")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id bigint, label int, codes array<int>, error bigint").select(F.lit(None).cast(rows.schema["vec_id"].dataType).alias("vec_id"), F.lit(None).cast(rows.schema["label"].dataType).alias("label"), "codes", "error"), np.zeros((PARTS, 0, 0), np.int64)
    rows = rows.where(F.size("v") == first["n"])
    width = first["n"] // PARTS
    books = first_books(rows)
    cut = F.posexplode(F.array(*(F.slice("v", p * width + 1, width) for p in range(PARTS)))).alias("pos", "part")
    distinct = stage.table(rows.select(cut).groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[["pos", "part"]].copy()
            found = np.zeros((2, len(pdf)), np.int64)
            places = pdf["pos"].to_numpy()
            for pos in np.unique(places):
                at = np.flatnonzero(places == pos)
                found[:, at] = nearest(np.stack(pdf["part"].to_numpy()[at]), books[pos])
            yield out.assign(code=found[0].astype("int32"), error=found[1])

    coded = distinct.select("pos", "part").mapInPandas(assign, "pos int, part array<bigint>, code int, error bigint")
    each = rows.select("row", "vec_id", "label", cut).join(coded, ["pos", "part"])
    whole = each.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"), F.sum("error").alias("error"))
    return whole.drop("row"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings; labels' errors add up with nulls as one label."""
    coded, books = encode(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = Stage(spark, "codes-result").table(coded, "coded")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = coded.select("vec_id", "label", code.alias("code"), "error").join(totals, F.expr("label <=> _label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_ROUND = f"""a{{k}} AS MATERIALIZED (SELECT pos, part, weight, aa, arg_min(code, (d, code)) AS code, min(d) AS d FROM
  (SELECT x.pos, x.part, x.weight, x.aa, c.code, c.cc - 2 * list_inner_product(x.f, c.f) AS d FROM x JOIN c{{k}} c USING (pos)) GROUP BY ALL)"""
_MOVE = """s{k} AS MATERIALIZED (SELECT pos, code, list(floor(s / n) ORDER BY i) AS f FROM (SELECT pos, code, i, sum(weight * v) AS s, sum(weight) AS n FROM
  (SELECT pos, code, weight, unnest(part) AS v, generate_subscripts(part, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT pos, code, f, list_inner_product(f, f) AS cc FROM (SELECT c.pos, c.code, coalesce(s.f, c.f) AS f FROM c{k} c LEFT JOIN s{k} s USING (pos, code)))"""
OP11_SQL = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, vec_id, label, pos, v[pos * len(v) // {PARTS} + 1:(pos + 1) * len(v) // {PARTS}] AS part FROM r, range({PARTS}) t(pos)),
x AS MATERIALIZED (SELECT pos, part, part::DOUBLE[] AS f, list_inner_product(part::DOUBLE[], part::DOUBLE[]) AS aa, count(*) AS weight FROM p GROUP BY pos, part),
c0 AS MATERIALIZED (SELECT pos, row - 1 AS code, part::DOUBLE[] AS f, list_inner_product(part::DOUBLE[], part::DOUBLE[]) AS cc FROM p WHERE row <= {ENTRIES}),
{", ".join(_ROUND.format(k=k) + ", " + _MOVE.format(k=k, n=k + 1) for k in range(ROUNDS))}, {_ROUND.format(k=ROUNDS)},
e AS MATERIALIZED (SELECT row, vec_id, label, string_agg(lower(printf('%02x', code)), '' ORDER BY pos) AS code, sum(aa + d)::BIGINT AS error FROM p JOIN a{ROUNDS} USING (pos, part) GROUP BY ALL),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY pos, code, i)) AS codebooks_sha256 FROM (SELECT pos, code, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""
