"""Quality rules: a ledger of failure bits and measurements, versioned policies and ablations.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit a rule;
policies are masks over these bits, so a new policy version or an ablation never rereads a text.

Null text counts as empty; repeated ids stay separate rows; an empty table gives an empty ledger. Words are
runs of characters other than ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, has_columns, small_batches, texts

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words"]


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: set = set()
            twice: set = set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            last = -1
            for k, w in enumerate(windows):
                if w in twice:
                    repeats += k + 2 - max(last, k - 1)
                    last = k + 2
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), upper, letters, len(set(words))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and one long column a measurement, from one pass over the texts."""
    docs = has_columns(docs, ["doc_id", "text"])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = list(zip(*map(measure, texts(batch)))) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A failing condition over the measurements, as SQL; ``bit`` is its place in the ledger for good."""

    bit: int
    name: str
    fails: str


#: Bits are never given out anew; a changed condition is a new rule.
RULES = (
    Rule(0, "short", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "upper_case", "10 * n_upper > 3 * n_letters"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(7, "few_distinct_words", "10 * n_distinct_words < n_words AND n_words >= 50"),
    Rule(8, "few_letters", "2 * n_letters < word_chars"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """Documents go that fail any rule of ``hard``, or more than ``tolerated`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    tolerated: int = 0

    def keeps(self, bits: str = "fail_bits") -> F.Column:
        return F.expr(f"({bits} & {self.hard}L) = 0 AND bit_count({bits} & {self.soft}L) <= {self.tolerated}")


POLICIES = (Policy("base-1", BASE), Policy("strict-1", (1 << len(RULES)) - 1), Policy("main-1", 0b100010111, 0b011101000, 1))
DEFAULT = POLICIES[2]


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits."""
    bits = " | ".join(f"CAST(IF({r.fails}, {1 << r.bit}, 0) AS BIGINT)" for r in rules) or "0L"
    return measurements(docs).withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return entries.withColumn("kept", policy.keeps())


def ablation(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule: documents failing the rule, and those that only this rule removes.

    Ledger rows are first counted by their bits (at most 2 to the number of rules groups), so a million
    documents with the same failures count once. ``fails_any`` and ``fails_all`` are the OR and the AND of the
    bits of the documents that the policy removes.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for p in policies:
        gone = ~p.keeps()
        aggs = [F.lit(p.version).alias("policy"), F.sum("n").alias("docs"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("removed"), F.bit_or(F.when(gone, F.col("fail_bits"))).alias("fails_any"), F.bit_and(F.when(gone, F.col("fail_bits"))).alias("fails_all")]
        for r in rules:
            without = Policy(p.version, p.hard & ~(1 << r.bit), p.soft & ~(1 << r.bit), p.tolerated)
            aggs += [F.sum(F.expr(f"IF((fail_bits >> {r.bit}) & 1L = 1, n, 0L)")).alias(f"fail_{r.name}"), F.sum(F.when(gone & without.keeps(), F.col("n")).otherwise(0)).alias(f"only_{r.name}")]
        parts.append(counts.groupBy().agg(*aggs))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the ledger of every row of ``documents`` and applies the default policy to it; null texts count as empty, repeated rows get an entry each."""
    entries = apply_policy(Stage(spark, "rules").table(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger"))
    return entries.select("doc_id", *MEASURES[:5], F.expr(f"(fail_bits & {BASE}L) <> 0").alias("base_failed"), "kept", "fail_bits")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: struct_pack(i := i, a := ws[i], b := ws[i + 1], c := ws[i + 2]))) AS x FROM w),
f AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.a, x.b, x.c) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM f WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
    coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, len(list_distinct(w.ws)) AS n_distinct_words
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END | CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    | CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END | CASE WHEN 10 * n_upper > 3 * n_letters THEN 16 ELSE 0 END | CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    | CASE WHEN 2 * word_chars < 5 * n_words THEN 64 ELSE 0 END | CASE WHEN 10 * n_distinct_words < n_words AND n_words >= 50 THEN 128 ELSE 0 END | CASE WHEN 2 * n_letters < word_chars THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 279) = 0 AND bit_count(fail_bits & 232) <= 1 AS kept, fail_bits FROM b
"""
