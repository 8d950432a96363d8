"""Importance resampling towards a target corpus through bucket-partitioned inverted postings.

A task turns its documents into blocks (bounded in documents and features) and each block into postings (bucket, document, count),
combined within the document, sorted by bucket and cut into ``SHARDS`` ranges of buckets. The postings are shuffled by shard and lot;
with them meet the sums of their buckets in both corpora, from which the task computes the gains of its buckets and emits each
block's contributions as one vector. Vectors of a block add up to its documents' weights.

No group grows with the corpus: a document adds one posting at most to a bucket, so a frequent word makes no key hot beyond the number of
documents, lots split a shard into groups of about ``PER_LOT`` blocks, and a block meets ``SHARDS`` vectors. To the driver come two totals
and two row counts.

Null and empty texts have no feature and weight 0. Repeated rows are documents of their own and get the same weight and score; ranks
among equal (score, doc_id) follow the feature count. A null doc_id is hashed as empty and ranks first among ties. Empty tables
give empty results, an empty target gives gains from its absence. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, has_columns, raw_texts, small_batches

BUCKETS, SHARDS, PER_LOT = 10_000, 64, 32
#: A block ends at so many documents or features.
BLOCK_DOCS, BLOCK_FEATURES = 4096, 1_000_000
MIN_WORDS, SHARE, SEED = 20, 25, 7
#: First bucket of each shard, and the end.
EDGES = -(-np.arange(SHARDS + 1) * BUCKETS // SHARDS)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all words and pairs of neighbours)."""
    words = text.translate(_WORD).split()
    single = list(map(crc32, words))
    pairs = map(crc32, map(b" ".__add__, words[1:]), single)  # a pair's checksum goes on from its first word's
    return len(words), np.array([*single, *pairs], np.int64) % BUCKETS


def _block(docs: list[tuple[int, np.ndarray]], ids: pa.Array, number: int, corpus: int, schema: pa.Schema) -> pa.RecordBatch:
    """One head row (shard -1) with ids and sizes, and a row of postings for each shard that has any."""
    n = len(docs)
    sizes = np.array([len(f) for _, f in docs], np.int64)
    keys = np.concatenate([f for _, f in docs]) * n + np.repeat(np.arange(n), sizes)
    keys, counts = np.unique(keys, return_counts=True)
    bucket, doc = keys // n, keys % n
    cuts = np.searchsorted(bucket, EDGES)
    rows = [{"corpus": corpus, "block": number, "shard": -1, "n_docs": n, "ids": ids, "words": [w for w, _ in docs], "features": sizes.tolist()}]
    for shard in range(SHARDS):
        a, b = cuts[shard], cuts[shard + 1]
        if a < b:
            own, width = bucket[a:b] - EDGES[shard], EDGES[shard + 1] - EDGES[shard]
            per_bucket = np.bincount(own, minlength=width).astype("<u4").tobytes()
            sums = np.bincount(own, weights=counts[a:b], minlength=width).astype(np.int64).tolist()
            rows.append({"corpus": corpus, "block": number, "shard": shard, "n_docs": n, "sums": sums, "sizes": per_bucket, "docs": doc[a:b].astype("<u4").tobytes(), "counts": counts[a:b].astype("<u4").tobytes()})
    return pa.RecordBatch.from_arrays([_ids_column(rows, f) if f.name == "ids" else pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _ids_column(rows: list[dict], field: pa.Field) -> pa.Array:
    """The head row's ids as one list, null elsewhere."""
    ids = rows[0]["ids"]
    return pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids, mask=pa.array([k > 0 for k in range(len(rows))])).cast(field.type)


def postings(corpora: DataFrame) -> DataFrame:
    """Blocks of (corpus, id, text), as ``_block`` makes them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = corpora.schema["id"].dataType.simpleString()
    ddl = f"corpus int, block bigint, shard int, n_docs int, ids array<{kind}>, words array<bigint>, features array<bigint>, sums array<bigint>, sizes binary, docs binary, counts binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}
        size = [0, 0]
        for batch in small_batches(batches, 256):
            ids = batch.column("id")
            for k, (corpus, text) in enumerate(zip(batch.column("corpus").to_pylist(), raw_texts(batch))):
                docs, own = held.setdefault(corpus, ([], []))
                docs.append(features(text))
                own.append(ids.slice(k, 1))
                size[corpus] += len(docs[-1][1])
                if len(docs) >= BLOCK_DOCS or size[corpus] >= BLOCK_FEATURES:
                    yield _block(docs, pa.concat_arrays(own), number, corpus, schema)
                    number, size[corpus] = number + 1, 0
                    del held[corpus]
        for corpus, (docs, own) in held.items():
            yield _block(docs, pa.concat_arrays(own), number, corpus, schema)
            number += 1

    return corpora.mapInArrow(run, ddl)


def gains(s: np.ndarray, t: np.ndarray, total_s: int, total_t: int) -> np.ndarray:
    """A bucket's gain in thousandths, floored."""
    return np.floor(1000 * np.log((t + 1.0) * (total_s + BUCKETS) / ((s + 1.0) * (total_t + BUCKETS)))).astype(np.int64)


def weights(spark: SparkSession, docs: DataFrame, target: DataFrame, name: str = "importance") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text); ``target`` has a text."""
    stage = Stage(spark, name)
    kind = docs.schema["doc_id"].dataType
    both = has_columns(docs, ["doc_id", "text"]).select(F.lit(0).alias("corpus"), F.col("doc_id").alias("id"), "text").unionByName(has_columns(target, ["text"]).select(F.lit(1).alias("corpus"), F.lit(None).cast(kind).alias("id"), "text"))
    rows = stage.table(postings(both), "postings")
    found = rows.where("shard >= 0")
    by_bucket = found.select("shard", "corpus", F.posexplode("sums").alias("k", "n")).groupBy("shard", "k").agg(F.sum(F.expr("IF(corpus = 0, n, 0)")).alias("s"), F.sum(F.expr("IF(corpus = 1, n, 0)")).alias("t"))
    by_bucket = stage.table(by_bucket, "sums")  # a row a bucket
    total = by_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    heads = rows.where("shard = -1 AND corpus = 0")
    lots = -(-heads.count() // PER_LOT) or 1
    shards = by_bucket.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("k", "s", "t"))).alias("b")).select("shard", F.col("b.s").alias("s"), F.col("b.t").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    own = found.where("corpus = 0").select("shard", F.pmod(F.xxhash64("block"), F.lit(lots)).cast("int").alias("lot"), "block", "n_docs", "sizes", "docs", "counts")
    met = own.join(shards.hint("shuffle_hash"), ["shard", "lot"])
    total_s, total_t = total["s"], total["t"]

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(SHARDS)(lambda shard, s, t: gains(np.frombuffer(s, np.int64), np.frombuffer(t, np.int64), total_s, total_t))
        for batch in small_batches(batches, 64):
            out = []
            for r in batch.to_pylist():
                gain = known(r["shard"], np.array(r["s"], np.int64).tobytes(), np.array(r["t"], np.int64).tobytes())
                each = np.repeat(gain, np.frombuffer(r["sizes"], "<u4")) * np.frombuffer(r["counts"], "<u4")
                sums = np.bincount(np.frombuffer(r["docs"], "<u4"), weights=each, minlength=r["n_docs"])  # sums below 2**53 are exact
                out.append(sums.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "part": pa.array(out, pa.binary())})

    parts = met.mapInArrow(contribute, "block bigint, part binary")
    every = heads.select("block", "ids", "words", "features", F.lit(None).cast("binary").alias("part")).unionByName(parts, allowMissingColumns=True)

    def reduce(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        k = table.column("part").is_null().index(True).as_py()
        total = np.zeros(len(table.column("words")[k].values), np.int64)
        for p in table.column("part").to_pylist():
            if p is not None:
                total += np.frombuffer(p, "<i8")
        words, n = (np.array(table.column(c)[k].as_py(), np.int64) for c in ("words", "features"))
        return pa.table({"doc_id": table.column("ids")[k].values, "n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    return every.groupBy("block").applyInArrow(reduce, f"doc_id {kind.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def draw(spark: SparkSession, weighed: DataFrame, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED, name: str = "draw") -> DataFrame:
    """Adds score (weight plus Gumbel noise from the id's hash) and rank among the drawn: ``share`` per cent of the documents with ``min_words`` words.

    Ranks come from a sort by range: places within a partition plus the sizes of the partitions before it.
    """
    stage = Stage(spark, name)
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296)))
    order = [F.col("_out"), F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features")]
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("_out", F.col("n_words") < min_words)
    rows = stage.table(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    eligible = rows.where("NOT _out").count()
    sizes = rows.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    out = rows.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(starts), "_part")
    return out.withColumn("rank", F.when(place <= share * eligible // 100, place)).drop("_part", "_place", "_start", "_out")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards ``benchmark``, its score, and its rank if it is drawn."""
    weighed = weights(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return draw(spark, weighed).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
w AS MATERIALIZED (SELECT corpus, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM
  (SELECT 0 AS corpus, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark)),
f AS MATERIALIZED (SELECT corpus, r, f, count(*) AS n FROM (SELECT corpus, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w) GROUP BY ALL),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM f) CROSS JOIN tab),
b AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 0), 0) AS s, coalesce(sum(n) FILTER (corpus = 1), 0) AS t FROM f JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM b),
d AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE corpus = 0 GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT AS h FROM w LEFT JOIN d USING (r) WHERE corpus = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (ORDER BY n_words < {MIN_WORDS}, score DESC, doc_id) END AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {SHARE} * (SELECT count(*) FROM z WHERE n_words >= {MIN_WORDS}) // 100 THEN k END AS rank FROM z
"""
