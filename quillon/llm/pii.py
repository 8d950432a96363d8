"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of four kinds (e-mail, IP address, card, phone), found leftmost and without overlap for each kind. The words beside an
entity are its lexical patterns: the last one to three before it and the first two or three behind it. Besides the seeds there are
candidates that no seed covers: tokens with an ``@``, four digits, or a
digit among five letters and digits. Patterns and the values beside them make a graph: a pattern
believes in a kind by the share of all its occurrences in the corpus that stand beside a reliable value of that kind, provided that
``SUPPORT`` different such values speak for it; a value is as reliable as its best pattern, a seed wholly. After ``ROUNDS`` rounds,
candidates beside a pattern of at least ``CONFIDENCE`` are added, with its best kind.

The words of the whole corpus are counted for patterns that enough different values share; a table of ``SLOTS`` bits, whatever the
number of patterns, keeps most other word runs from the shuffle, and an exact join drops the rest. Values and patterns that
repeat are counted before they are joined, so copies make no hot key; copies add no support either, since that counts different values.

Null texts count as empty; documents without a find get an empty list. Repeated rows get the same result each, null doc_ids
theirs; an empty table gives an empty one. Positions are code points, ends exclusive. Words cut by the ``WINDOW`` of a context are not read.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, has_columns
from .decontam import LOWER, UPPER, once

KINDS = ["email", "ip", "card", "phone"]
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.5, 3
WINDOW, SLOTS = 200, 1 << 19

#: The four kinds. Repeats are possessive and starts guarded where that finds the same, so that long runs are read once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "contains(t, '@')", "ip": "t RLIKE '[0-9][.][0-9]'", "card": "t RLIKE '[0-9][0-9 -][0-9 -]?[0-9]'", "phone": "contains(t, '+')"}
#: A candidate: a token with a digit or @, and groups of digits that follow after one space.
_TOKEN = r"[A-Za-z0-9_%+@()./#\x{80}-\x{10FFFF}-]"
CANDIDATE = rf"(?<!{_TOKEN})(?={_TOKEN}*[0-9@]){_TOKEN}++(?:\x20[0-9(+][0-9().+/-]*+(?!{_TOKEN}))*+"
#: Words of a context: letters and the marks : = #, which announce values.
SEPARATORS = r"[\x00-\x22\x24-\x39\x3B\x3C\x3E-\x60\x7B-\x7F]+"

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = f"length(x) BETWEEN 14 AND 19 AND aggregate(transform(sequence(1, length(x)), i -> IF(i % 2 = 1, int(substring(x, -i, 1)), int(substring(x, -i, 1)) * 2 - IF(int(substring(x, -i, 1)) > 4, 9, 0))), 0, (a, b) -> a + b) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    "card": once(_DIGITS.format(m="m"), "x", _LUHN),
    "phone": f"length({_DIGITS.format(m='m')}) BETWEEN 10 AND 15",
    "": f"length({_DIGITS.format(m='m')}) >= 4 OR contains(m, '@') OR length(regexp_replace(m, '[^A-Za-z0-9]', '')) >= 5",
}


def _words(text: str) -> str:
    return f"array_remove(split(translate({text}, '{UPPER}', '{LOWER}'), r'{SEPARATORS}', -1), '')"


def _before(piece: str) -> str:
    cut = once(_words(f"right({piece}, {WINDOW})"), "ws", f"IF(length({piece}) > {WINDOW}, slice(ws, 2, greatest(size(ws) - 1, 0)), ws)")
    return once(cut, "ws", "slice(ws, greatest(size(ws) - 2, 1), 3)")


def _behind(piece: str) -> str:
    cut = once(_words(f"left({piece}, {WINDOW})"), "ws", f"IF(length({piece}) > {WINDOW}, slice(ws, 1, greatest(size(ws) - 1, 0)), ws)")
    return once(cut, "ws", "slice(ws, 1, 3)")


def _found(kind: int, name: str, regex: str, guard: str) -> str:
    """SQL for the matches of one kind in ``t``; pieces of text between matches give places and contexts."""
    wanted = f"({_VALID[name]})"
    one = f"""named_struct('kind', {kind}, 'k', k, 'skip', length(ps[k]), 'm', m, 'valid', {wanted}, 'before', IF({wanted}, {_before('ps[k]')}, NULL), 'behind', IF({wanted}, {_behind('ps[k + 1]')}, NULL))"""
    return f"IF({guard}, {once(f'''split(t, r'{regex}', -1)''', 'ps', f'''transform(regexp_extract_all(t, r'{regex}', 0), (m, k) -> {one})''')}, NULL)"


def _gram(words: str, n: int) -> str:
    return f"xxhash64({', '.join(f'{words}[{k}]' for k in range(n))})"


def _patterns() -> str:
    """SQL for the patterns of a find: structs (side, h, gram)."""
    out = []
    for side, words, sizes in (("before", "before", (1, 2, 3)), ("behind", "behind", (2, 3))):
        for n in sizes:
            run = f"slice({words}, {f'size({words}) - {n - 1}' if side == 'before' else 1}, {n})"
            out.append(f"IF(size({words}) >= {n}, {once(run, 'g', f'''named_struct('side', '{side}', 'h', {_gram('g', n)}, 'gram', array_join(g, ' '))''')}, NULL)")
    return f"filter(array({', '.join(out)}), x -> x IS NOT NULL)"


def finds(stage: Stage, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id of every document; row, kind (0: candidate), start, end, value, patterns of seeds and of candidates apart from them)."""
    kinds = [_found(k + 1, name, PATTERNS[name], _GUARDS[name]) for k, name in enumerate(KINDS)] + [_found(0, "", CANDIDATE, "t RLIKE '[0-9@]'")]
    texts = has_columns(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    every = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(F.expr(x).alias(f"f{k}") for k, x in enumerate(kinds)))
    every = stage.table(every, "documents")
    rows = None
    for k in range(len(kinds)):
        own = every.where(f"size(f{k}) > 0").select("row", F.inline(f"f{k}"))
        rows = own if rows is None else rows.unionByName(own)
    at = Window.partitionBy("row", "kind").orderBy("k")
    start = F.sum("skip").over(at.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("m")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start).where("valid")
    lead = F.expr("IF(kind = 0, ltrim('.-/%)', m), m)")
    rows = rows.withColumn("m2", lead).withColumn("start", F.expr("start + length(m) - length(m2)")).withColumn("m", F.expr("IF(kind = 0, rtrim('.-/%(+#', m2), m2)")).withColumn("end", F.expr("start + length(m)"))
    near = Window.partitionBy("row").orderBy("start", "kind")
    seed_end, seed_start = F.expr("IF(kind > 0, end, NULL)"), F.expr("IF(kind > 0, start, NULL)")
    rows = rows.withColumn("last", F.max(seed_end).over(near.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.min(seed_start).over(near.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.where("kind > 0 OR NOT (coalesce(last > start, false) OR coalesce(next < end, false))")
    value = F.lower(F.regexp_replace("m", "[^A-Za-z0-9@]", ""))
    return every.select("row", "doc_id"), stage.table(rows.select("row", "kind", "start", "end", value.alias("value"), F.expr(_patterns()).alias("patterns")), "finds")


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, total: how often the corpus has each wanted run of one to three words."""
    bits = [0] * -(-SLOTS // 64)
    for r in wanted.select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("s")).distinct().toLocalIterator():  # SLOTS values at most
        bits[r["s"] >> 6] |= 1 << (r["s"] & 63)
    table = ",".join(str(b - (b >> 63 << 64)) for b in bits)  # folded into one constant array
    runs = ", ".join(f"IF(size(ws) >= {n}, transform(sequence(0, greatest(size(ws) - {n}, 0)), i -> xxhash64({', '.join(f'ws[i + {k}]' for k in range(n))})), CAST(array() AS array<bigint>))" for n in (1, 2, 3))
    slot = f"CAST(pmod(h, {SLOTS}) AS INT)"
    likely = f"filter(concat({runs}), h -> getbit(element_at(CAST(split('{table}', ',') AS array<bigint>), shiftright({slot}, 6) + 1), {slot} & 63) = 1)"
    marked = docs.select(F.col("text").alias("t"))
    hs = marked.where("t IS NOT NULL").select(F.explode(F.expr(once(_words("t"), "ws", likely))).alias("h"))
    return hs.groupBy("h").agg(F.count("*").alias("total")).join(wanted.select("h").distinct(), "h")


def extract(spark: SparkSession, docs: DataFrame, name: str = "pii") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id; row, kind, start, end, base, confidence of all spans; side, gram, kind, values, total, confidence of the patterns)."""
    stage = Stage(spark, name)
    ids, found = finds(stage, docs)
    edges = found.select("value", "kind", F.inline("patterns")).groupBy("side", "h", "value").agg(F.first("gram").alias("gram"), F.count("*").alias("n"))
    edges = stage.table(edges, "edges")
    wanted = edges.groupBy("side", "h").agg(F.count("*").alias("values"), F.sum("n").alias("beside")).where(F.col("values") >= SUPPORT)
    wanted = stage.table(wanted, "wanted")
    totals = stage.table(occurrences(has_columns(docs, ["text"]), wanted), "totals")
    known = wanted.join(totals, "h", "left").select("side", "h", F.greatest(F.coalesce("total", "beside"), "beside").alias("total"))
    # beside / total bounds what a pattern can reach, so those below the threshold are out for good
    known = known.join(wanted.select("side", "h", "beside"), ["side", "h"]).where(F.col("beside") >= CONFIDENCE * F.col("total")).drop("beside")
    links = stage.table(edges.join(known, ["side", "h"]), "links")
    seeds = stage.table(found.where("kind > 0").select("value", "kind").distinct().withColumn("trust", F.lit(1.0)), "seeds")
    trust = seeds
    for k in range(ROUNDS):
        scores = links.join(trust, "value").groupBy("side", "h", "kind").agg(F.first("gram").alias("gram"), F.first("total").alias("total"), F.sum("trust").alias("values"), F.round(F.sum(F.col("n") * F.col("trust")) / F.first("total"), 9).alias("confidence"))
        scores = stage.table(scores.where(F.round("values", 9) >= SUPPORT), f"scores{k}")
        if k + 1 < ROUNDS:
            told = links.select("side", "h", "value").join(scores.select("side", "h", "kind", "confidence"), ["side", "h"]).groupBy("value", "kind").agg(F.max("confidence").alias("trust"))
            trust = stage.table(seeds.unionByName(told).groupBy("value", "kind").agg(F.max("trust").alias("trust")), f"trust{k}")
    strong = scores.where(F.col("confidence") >= CONFIDENCE)
    best = F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b")
    added = found.where("kind = 0").select("row", "start", "end", F.inline("patterns")).join(strong.select("side", "h", "kind", "confidence"), ["side", "h"]).groupBy("row", "start", "end").agg(best)
    added = added.select("row", (-F.col("b.k")).alias("kind"), "start", "end", F.lit(False).alias("base"), F.col("b.confidence").alias("confidence"))
    spans = found.where("kind > 0").select("row", "kind", "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("confidence")).unionByName(added)
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return ids, spans.withColumn("kind", named), strong.withColumn("kind", named).select("side", "gram", "kind", "values", "total", "confidence")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the seeds and all spans of every document."""
    ids, spans, _ = extract(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", place.alias("k"), "end", "kind", "base")
    lists = spans.groupBy("row").agg(*(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS), F.sort_array(F.collect_list(one)).alias("s"))
    text = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    lists = lists.withColumn("base_sha256", F.sha2(F.expr(text.format("filter(s, x -> x.base)")), 256)).withColumn("spans", F.expr(text.format("s")))
    out = ids.join(lists, "row", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
