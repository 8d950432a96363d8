"""Line dedup by content-defined line chunks, in DataFrame operations only.

The hash of a line decides whether it is a boundary (two lines of three are); the rolling window is one line wide, as wider ones lose
short passages. Blank lines (nothing but spaces, tabs and carriage returns) are never boundaries, so a chunk has two lines of text at least
and a paragraph between blank lines isn't a chunk by itself. A chunk reaches from one boundary to the next, both included, so neighbouring chunks share a line: what lies between a passage's
first and last boundary is found wherever the passage stands, whatever surrounds it. The first and the last line with text count as boundaries.
A line goes if a chunk that it is in occurs byte for byte earlier in the corpus (by doc_id, then place). As each removed line stands in an
earlier occurrence of its chunk, every line stays at least once. Texts of one line stay.

Rows with the same doc_id and text are one document and get the same result each. Null text stays null and has no line; an empty
table gives an empty one. All other columns pass through; names that start with __ld_ and _n_lines, _n_removed_chunks and
_n_removed_lines are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, has_columns
from .decontam import once

#: A line is a boundary unless its hash is divisible by ODDS.
ODDS = 3
#: A first occurrence's bytes are dealt out so many times that each copy meets about so many later ones.
HOT = 1000
#: Up to so many first occurrences (a few dozen bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def chunks_of(text: str = "text") -> str:
    """SQL for a text's chunks: structs (at, n, body) of first lines (from 1), line counts and texts."""
    filled = r"filter(sequence(1, size(ls)), i -> translate(ls[i - 1], ' \t\r', '') <> '')"
    points = f"filter(ts, i -> i = ts[0] OR i = element_at(ts, -1) OR hs[i - 1] % {ODDS} <> 0)"
    chunk = "transform(slice(ps, 1, greatest(size(ps) - 1, 0)), (p, k) -> named_struct('at', p, 'n', ps[k + 1] - p + 1, 'body', array_join(slice(ls, p, ps[k + 1] - p + 1), '\n')))"
    hashes = "transform(ls, l -> CAST(conv(left(md5(l), 7), 16, 10) AS BIGINT))"
    return once(f"split({text}, '\n', -1)", "ls", once(hashes, "hs", once(filled, "ts", once(points, "ps", chunk))))


def dedup_lines(spark: SparkSession, docs: DataFrame, name: str = "lines") -> DataFrame:
    """The documents with removed chunks taken out of ``text``, and _n_lines, _n_removed_lines, _n_removed_chunks."""
    stage = Stage(spark, name)
    slim = has_columns(docs, ["doc_id", "text"]).where("text is not null").withColumn("__ld_text_hash", F.xxhash64("text"))
    exploded = slim.select("doc_id", "__ld_text_hash", F.posexplode(F.expr(chunks_of())).alias("k", "c"))
    multi = exploded.select("doc_id", "__ld_text_hash", "k", F.xxhash64("c.body").alias("h1"), F.xxhash64(F.lit(1), "c.body").alias("h2"), F.octet_length("c.body").alias("size"))
    place = F.struct("doc_id", "__ld_text_hash", "k")
    spots = stage.table(multi.distinct(), "spots")
    firsts = spots.groupBy("h1", "h2", "size").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = stage.table(firsts, "firsts")
    later = spots.join(firsts, ["h1", "h2", "size"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "__ld_text_hash", "k", "h1", "h2", "size", F.pmod(F.xxhash64("doc_id", "k"), F.ceil(F.col("n") / HOT)).alias("lot"))
    # the bytes of the first occurrences, then a comparison with each later one
    wanted = F.collect_list(F.struct(F.col("first.k").alias("k"), "h1", "h2", "size", "n")).alias("__ld_wanted")
    heads = firsts.groupBy(F.col("first.doc_id").alias("__ld_id"), F.col("first.__ld_text_hash").alias("__ld_hash")).agg(wanted)
    heads = F.broadcast(heads) if firsts.count() <= BROADCAST_ROWS else heads
    owners = slim.join(heads, F.expr("doc_id <=> __ld_id AND __ld_text_hash = __ld_hash"))
    # a text is cut once for all its chunks, and only their bytes are shuffled
    found = once(chunks_of(), "cs", "transform(__ld_wanted, x -> named_struct('h1', x.h1, 'h2', x.h2, 'size', x.size, 'n', x.n, 'body', cs[x.k].body))")
    bodies = owners.select(F.inline(F.expr(found))).dropDuplicates(["h1", "h2", "size"])
    bodies = stage.table(bodies, "bodies").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / HOT) - 1)))
    doomed = later.join(bodies, ["h1", "h2", "size", "lot"]).groupBy("doc_id", "__ld_text_hash").agg(F.collect_list(F.struct("k", "body")).alias("__ld_same"))
    doomed = doomed.select(F.col("doc_id").alias("__ld_id"), F.col("__ld_text_hash").alias("__ld_hash"), "__ld_same")
    out = docs.withColumn("__ld_text_hash", F.xxhash64("text")).join(doomed, F.expr("doc_id <=> __ld_id AND __ld_text_hash = __ld_hash"), "left").drop("__ld_id", "__ld_hash", "__ld_text_hash")
    gone = "array_compact(transform(__ld_same, s -> IF(cs[s.k].body = s.body, s.k, NULL)))"
    lines = "array_distinct(flatten(transform(gs, k -> sequence(cs[k].at, cs[k].at + cs[k].n - 1))))"
    rest = "transform(array_except(sequence(1, size(ls)), xs), i -> ls[i - 1])"
    facts = f"named_struct('chunks', size(gs), 'lines', size(xs), 'text', array_join({rest}, '\\n'))"
    facts = once(gone, "gs", once(lines, "xs", once("split(text, '\\n', -1)", "ls", facts)))
    out = out.withColumn("__ld_facts", F.expr(f"IF(__ld_same IS NULL, NULL, {once(chunks_of(), 'cs', facts)})"))
    out = out.withColumn("_n_lines", F.coalesce(F.size(F.split("text", "\n", -1)).cast("long") * F.when(F.col("text").isNull(), 0).otherwise(1), F.lit(0).cast("long")))
    out = out.withColumn("_n_removed_chunks", F.coalesce("__ld_facts.chunks", F.lit(0)).cast("long")).withColumn("_n_removed_lines", F.coalesce("__ld_facts.lines", F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("_n_removed_chunks") == 0, F.col("text")).otherwise(F.col("__ld_facts.text"))).drop("__ld_same", "__ld_facts")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed chunks and lines of every row of ``documents``; null texts have no line and a null digest, rows that repeat id and text get the same result each."""
    out = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed_chunks").alias("n_removed_chunks"), F.col("_n_removed_lines").alias("n_removed_lines"), F.md5("text").alias("kept_md5"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, i, line, ('0x' || left(md5(line), 7))::BIGINT AS h, translate(line, ' ' || chr(9) || chr(13), '') <> '' AS filled FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL)),
p AS (SELECT r, doc_id, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT *, min(i) OVER (PARTITION BY r) AS a, max(i) OVER (PARTITION BY r) AS z FROM l WHERE filled) WHERE i = a OR i = z OR h % 3 <> 0),
k AS (SELECT p.r, p.doc_id, p.i, p.j, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM p JOIN l ON l.r = p.r AND l.i BETWEEN p.i AND p.j WHERE p.j IS NOT NULL GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, r, i) > 1 AS gone FROM k),
g AS (SELECT DISTINCT l.r, l.i FROM l JOIN f ON l.r = f.r AND l.i BETWEEN f.i AND f.j WHERE f.gone),
c AS (SELECT r, count(*) AS n_removed_chunks FROM f WHERE gone GROUP BY r),
o AS (SELECT r, count(*) AS n_lines, any_value(coalesce(c.n_removed_chunks, 0)) AS n_removed_chunks, count(g.i) AS n_removed_lines, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_md5
  FROM l LEFT JOIN g USING (r, i) LEFT JOIN c USING (r) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, kept_md5 FROM d LEFT JOIN o USING (r)
"""
