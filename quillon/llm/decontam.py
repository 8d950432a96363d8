"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``width`` consecutive words of an item (a shorter item is one window). The set elements are shingles of up to
three words. Since a window has to be contained exactly, its necessary prefix is one shingle: the rarest in the documents
(ties by hash, then place). Documents are searched for prefix shingles alone; a match fixes where the window must
start, the length bound drops starts that leave the text, and the words of the whole window are then compared.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null has no words: such documents are clean, such
items have no window. Rows that repeat a doc_id get their own result; repeated items count once for each different item_id, and
null item_ids are ignored. With an empty benchmark all documents are clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, has_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Up to so many prefix shingles are put into the scan as constants (half a megabyte); more are joined.
LITERALS = 65_536


def words_of(column: str = "text") -> F.Column:
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def once(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` bound to ``name``: a lambda's variable is computed once, a column may be inlined into a lambda and computed for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingle(words: str, i: str, width: int) -> str:
    return f"xxhash64({', '.join(f'{words}[{i} + {k}]' for k in range(width))})"


def windows(benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(different windows: window, win, size; which items hold them: window, item_id)."""
    items = has_columns(benchmark, ["item_id", "text"]).where("item_id is not null").withColumn("w", words_of()).where("size(w) > 0").select("item_id", "w")
    rows = items.select("item_id", F.explode(F.expr(once("w", "v", f"transform(sequence(0, greatest(size(v) - {width}, 0)), i -> slice(v, i + 1, {width}))"))).alias("win"))
    rows = rows.withColumn("window", F.sha2(F.array_join("win", " "), 256)).distinct()
    return rows.select("window", "win", F.size("win").alias("size")).dropDuplicates(["window"]), rows.select("window", "item_id").distinct()


def _shingles(wins: DataFrame) -> DataFrame:
    """window, offset, kind (words of the shingle), shingle: every shingle of every window."""
    cases = " ".join(f"WHEN size = {k} THEN {_shingle('win', 'i', k)}" for k in range(1, SHINGLE))
    return wins.select("window", "win", "size", F.least("size", F.lit(SHINGLE)).alias("kind"), F.explode(F.expr(f"sequence(0, size - least(size, {SHINGLE}))")).alias("i")).withColumn("shingle", F.expr(f"CASE {cases} ELSE {_shingle('win', 'i', SHINGLE)} END"))


def _keyed(kind: int) -> str:
    """SQL for the structs (i, shingle) of all places in ``w`` where ``kind`` words follow."""
    places = f"IF(size(v) >= {kind}, sequence(0, greatest(size(v) - {kind}, 0)), CAST(array() AS array<int>))"
    return once("w", "v", f"transform({places}, i -> named_struct('i', i, 'shingle', {_shingle('v', 'i', kind)}))")


def _found(kind: int, wanted: list[int]) -> str:
    """The same for the places where a wanted shingle begins."""
    listed = ", ".join(f"{s}L" if s > -(2**63) else "(-9223372036854775807L - 1L)" for s in wanted) or "NULL"
    return f"filter({_keyed(kind)}, x -> x.shingle IN ({listed}))"


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, literals: int = LITERALS, name: str = "decontam") -> DataFrame:
    """One row a document: doc_id, _text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    stage = Stage(spark, name)
    wins, items = windows(benchmark, width)
    wins = stage.table(wins, "windows")
    shingles = stage.table(_shingles(wins), "shingles")
    base = has_columns(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"), words_of().alias("w"))
    n_shingles = shingles.select("shingle").distinct().count()
    small = n_shingles <= literals  # n_shingles is the benchmark's, so each list below has a proven bound
    kinds = sorted(r["kind"] for r in shingles.select("kind").distinct().collect())  # at most SHINGLE values

    def matches(wanted: DataFrame, keep: list[str]) -> DataFrame:
        """Places in the documents of the wanted shingles (kind, shingle)."""
        out = None
        for kind in kinds:
            own = wanted.where(F.col("kind") == kind).select("shingle").distinct()
            some = base.where(F.size("w") >= kind)
            if small:
                hits = F.expr(_found(kind, [r["shingle"] for r in own.collect()]))
                found = some.select(*keep, F.explode(hits).alias("x")).select(*keep, "x.i", "x.shingle")
            else:
                places = some.select("doc_id", "_text_hash", F.explode(F.expr(_keyed(kind))).alias("x")).select("doc_id", "_text_hash", "x.i", "x.shingle").join(own, "shingle")
                owners = some.dropDuplicates(["doc_id", "_text_hash"]).select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), "w")
                found = places.join(owners, F.expr("doc_id <=> _id AND _text_hash = _hash")) if "w" in keep else places
                found = found.select(*keep, "i", "shingle")
            found = found.withColumn("kind", F.lit(kind))
            out = found if out is None else out.unionByName(found)
        return out

    sizes = base.select("doc_id", "_text_hash", F.size("w").cast("long").alias("n_words"))
    if not kinds:
        return sizes.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    rarity = stage.table(matches(shingles, []).groupBy("kind", "shingle").agg(F.count("*").alias("n")), "rarity")
    # a shingle that no document has rules its window out; else the rarest one is the window's prefix
    prefix = shingles.join(rarity, ["kind", "shingle"], "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", F.col("i").alias("offset"))).alias("p"), F.first("kind").alias("kind"))
    prefix = stage.table(prefix.where("p.n > 0").select("window", "kind", "p.shingle", "p.offset").join(wins, "window"), "prefix")
    context = F.expr(f"slice(w, greatest(i - {width}, 0) + 1, {2 * width + 1})").alias("around"), F.expr(f"greatest(i - {width}, 0)").alias("from"), F.size("w").alias("n_words")
    found = matches(prefix, ["doc_id", "_text_hash", "w"]).select("doc_id", "_text_hash", "i", "shingle", "kind", *context)
    found = stage.table(found.distinct(), "found")
    near = F.broadcast if small else (lambda df: df)
    begun = found.join(near(prefix.select("window", "kind", "shingle", "offset", "win", "size")), ["kind", "shingle"]).withColumn("start", F.expr("i - offset"))
    exact = begun.where("start >= 0 AND start + size <= n_words").where(F.expr("slice(around, start - `from` + 1, size) = win"))
    exact = stage.table(exact.select("doc_id", "_text_hash", "window", "start", "size").distinct(), "exact")
    covered = exact.groupBy("doc_id", "_text_hash").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + size - 1)"))))).cast("long").alias("n_hit"))
    held = exact.select("doc_id", "_text_hash", "window").distinct().join(near(items), "window").select("doc_id", "_text_hash", F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy("doc_id", "_text_hash").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    covered = covered.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_hash", "_hash")
    result = covered.join(held, F.expr("doc_id <=> _id AND _text_hash = _hash")).drop("doc_id", "_text_hash")
    out = sizes.join(result, F.expr("doc_id <=> _id AND _text_hash = _hash"), "left")
    return out.select("doc_id", "_text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``benchmark`` in every row of ``documents``; null texts have no words, repeated rows get the same result each."""
    out = contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("_text_hash")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN win USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
