"""Line chunks: recall on passages in other surroundings, nothing lost, equal to a plain version."""

import hashlib
import random

from quillon.llm import linededup


def plain(rows):
    """doc_id -> text by the rule, one document after the other; ids are unique."""
    seen, out = set(), {}
    for i, text in sorted((i, t) for i, t in rows if t is not None):
        ls = text.split("\n")
        filled = [k for k, x in enumerate(ls) if x.strip(" \t\r")]
        at = [k for k in filled if k in (filled[0], filled[-1]) or int(hashlib.md5(ls[k].encode()).hexdigest()[:7], 16) % 3]
        gone = set()
        for a, b in zip(at, at[1:]):
            body = tuple(ls[a : b + 1])
            gone |= set(range(a, b + 1)) if body in seen else set()
            seen.add(body)
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_passages_in_other_surroundings(spark):
    r = random.Random(5)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(12))
    passages = [[line() for _ in range(r.randint(5, 8))] for _ in range(60)]
    rows = [(2 * k + copy, "\n".join([line() for _ in range(r.randint(1, 4))] + p + [line() for _ in range(r.randint(1, 4))])) for k, p in enumerate(passages) for copy in (0, 1)]
    clean = [(1000 + k, "\n".join(line() for _ in range(6))) for k in range(20)]
    odd = [(2000, None), (2001, ""), (2002, "one line"), (2003, "one line"), (2004, "\n\n\n\n"), (2005, "a\nb\na\nb\na\nb"), (2006, "a\nb"), (2007, "x" * 200_000 + "\ny"), (2008, "x" * 200_000 + "\ny")]
    rows += clean + odd
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: t for i, t in got.items() if i != 2000} == plain(rows) and got[2000] is None
    assert all(got[i] == t for i, t in clean) and got[2003] == "one line"
    touched = sum(got[2 * k + 1] != rows[2 * k + 1][1] for k in range(60))
    gone = sum(x not in got[2 * k + 1].split("\n") for k, p in enumerate(passages) for x in p) / sum(map(len, passages))
    assert touched >= 54 and gone > 0.7
    kept = {x for t in got.values() if t is not None for x in t.split("\n")}
    assert all(x in kept for _, t in rows if t is not None for x in t.split("\n"))  # every line stays somewhere


def test_blank_lines(spark):
    """Paragraph breaks and single paragraphs between blank lines stay; repeated passages with blank lines inside go."""
    r = random.Random(9)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(8))
    alone = [(1, "head\n\nSame paragraph\n\ntail"), (2, "kopf\n\nSame paragraph\n\nschwanz vier"), (3, "alpha one\n\n\nbeta two"), (4, "gamma three\n\n\ndelta four"), (5, "\n \n\t\r\n"), (6, "\n \n\t\r\n"), (7, "\n\nsame\n\n"), (8, "\n\nsame\n\n")]
    passage = "\n\n".join(line() for _ in range(8))
    rows = alone + [(20 + k, f"{line()}\n{line()}\n\n{passage}\n\n{line()}\r\n \n{line()}") for k in range(4)]
    rows += [(100 + k, "\n".join(r.choice(["", " ", "p", "q", "r s", "t"]) for _ in range(r.randint(0, 12)))) for k in range(80)]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain(rows) and all(got[i] == t for i, t in alone)
    assert all(len(got[k]) < len(rows[0][1]) + 8 * 40 for k in (21, 22, 23)) and passage in got[20]


def test_sql_has_the_same_rule(spark, tmp_path):
    import duckdb

    r = random.Random(3)
    rows = [(k, None if k % 9 == 0 else "\n".join(r.choice(["", "\t", "p", "q", "r s", "t", "u v w"]) for _ in range(r.randint(0, 12)))) for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", "kept_md5"]
    want = duck.sql(linededup.OP5_SQL).df()[columns].astype(object)
    got = linededup.op5_line_dedup(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:4], None if r[4] != r[4] else r[4]) for r in want.itertuples(index=False, name=None))
    assert sum(r.n_removed_lines for r in got) > 50
