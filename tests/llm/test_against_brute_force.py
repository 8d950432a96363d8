import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, gbt, lbl, neardup, packing, rans, suffixdedup, wordpiece
from quillon.llm.induced import suffix_order
from quillon.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    cell = lambda v: "-" if v is None or v != v else str(int(v)) if not isinstance(v, str) and v == int(v) else str(v)  # noqa: E731  null integers come as floats
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


def test_bpe_is_the_library():
    c = bpe.cached_bpe(bpe.default_vocabulary())
    r = np.random.default_rng(2)
    parts = np.array(["a", "Bee", " ", "  ", "\n", "\t", "1", "é", " ", "　", ".", "'s", "'", "\x00", "ü", "中", "😀", "<|endoftext|>", "\r\n", "word", ",", " The", "́", "***", ".", "!?", "_", "-", "\n\n"])
    texts = ["".join(r.choice(parts, r.integers(0, 16))) for _ in range(4000)]
    for t, got in zip(texts, c.encode(texts)):
        assert np.frombuffer(got, c.dtype).tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_are_the_library():
    from tokenizers import Tokenizer

    c, library = bpe.cached_bpe(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    for t in ("<|endoftext|>", "a word <|endoftext|> and more", "x<|endoftext|>y", "plain words only"):
        assert np.frombuffer(c.encode([t])[0], c.dtype).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 300_000])
def test_rans_kernel(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 40_000).astype(np.int64)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=50_257) + (np.arange(50_257) == 3)))
    block = rans.encode(ids, np.array([n]), table)
    got, docs = rans.decode(block, table)
    assert (got == ids).all() and docs.tolist() == [n]
    step = rans.STRIDE * rans.LANES
    for k in range(-(-n // step)):
        part, _ = rans.decode(block, table, k)
        assert (part == ids[k * step : k * step + step]).all()
    with pytest.raises(rans.CorruptBlock):
        rans.decode(block[:40] + bytes([block[40] ^ 1]) + block[41:], table)


def test_wordpiece_counts():
    starts, inner = wordpiece.byte_level_pieces(bpe.default_vocabulary())
    a, s, i = wordpiece.Automaton(starts, inner), set(starts), set(inner)

    def brute(w):
        n, at, w = 0, 0, b" " + w
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if (w[at:e] in i if at else w[1:e] in s and e)), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    import pyarrow.parquet as pq

    words = {w for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() for w in (t or "").encode().split()}
    words |= {w.encode() for w in ("สวัสดีชาวโลก", "Привет", "日本語", "ñandú", "עולם", "😀😀", "ÿ", "ƒx")} | {bytes([b, 97]) for b in range(33, 256)}
    assert all(a.count(w) == brute(w) for w in words) and a.count("สวัสดีชาวโลก".encode()) > 5
    tiny = wordpiece.Automaton([b"a", b"abcd"], [b"b", b"bc", b"cde"])
    assert [tiny.count(w) for w in (b"abcd", b"abc", b"abcde", b"z", b"")] == [1, 2, 1, 1, 0]


def test_plan_is_a_packing():
    r = np.random.default_rng(1)
    for _ in range(5):
        counts = np.bincount(np.clip(r.lognormal(5.5, 1, 20_000).astype(int), 1, 1024), minlength=1025)
        runs = packing.plan(counts)
        used = np.zeros(1025, int)
        for number, contents in runs:
            assert sum(n * k for n, k in contents) <= 1024
            for n, k in contents:
                used[n] += number * k
        assert (used == counts).all()
        assert sum(n for n, _ in runs) <= 1.03 * -(-(counts * np.arange(1025)).sum() // 1024)
    assert packing.plan(np.zeros(1025, int)) == []


def test_suffix_order():
    r = np.random.default_rng(3)
    for _ in range(300):
        s, n = int(r.integers(1, 5)), int(r.integers(1, 60))
        t = r.integers(0, s, n).astype(np.int16)
        assert suffix_order(t, s, 200, limit=int(r.integers(1, 30))).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("width,gram,split", [(400, 128, 2000), (60, 20, 2)])
def test_repeats(spark, docs, width, gram, split):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(b[p : p + width] for _, b in rows for p in range(len(b) - width + 1))
    want = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = True
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(spark, docs, width, gram, split).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_near_duplicates(spark):
    r = np.random.default_rng(9)
    words = np.array([f"w{k}" for k in range(5000)])
    rows, i = [], 0
    for _ in range(25):
        base = r.choice(words, 120)
        for _ in range(int(r.integers(1, 9))):
            own = base.copy()
            at = r.integers(0, 120, int(r.integers(0, 6)))
            own[at] = r.choice(words, len(at))
            rows.append((i, " ".join(own)))
            i += 1
    sets = {k: frozenset(zip(w, w[1:], w[2:])) for k, w in ((k, t.split()) for k, t in rows)}
    best = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {x.doc_id: x.component_id for x in got} == best and all(x.n_shingles == len(sets[x.doc_id]) for x in got)


def test_links_across_cuts(spark, monkeypatch):
    """A family just below the threshold that is many times a region's size, with planted copies in it: none is lost."""
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "SIDE", 16)
    r = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5000)])
    base = r.choice(words, 112)

    def changed(text, n):
        own = text.copy()
        own[3 * r.choice(np.arange(1, 37), n, replace=False)] = r.choice(words, n)
        return own

    family = [changed(base, 2) for _ in range(150)]
    family += [changed(x, 2) for x in family[:60]]
    sets = [set(zip(w, w[1:], w[2:])) for w in map(list, family)]
    best = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and best[a] != best[b]:
                low, high = sorted((best[a], best[b]))
                best = [low if x == high else x for x in best]
    rows = [(k, " ".join(w)) for k, w in enumerate(family)]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert len(set(best)) > 60 and {x.doc_id: x.component_id for x in got} == dict(enumerate(best))


def test_large_region_is_cut():
    import pyarrow as pa

    r = np.random.default_rng(1)
    n = 500
    sig = np.sort(r.integers(0, 3, (n, neardup.VALUES), dtype=np.uint8).view(f"V{neardup.VALUES}").ravel())
    raw = [x.tobytes() for x in sig]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array(raw, pa.binary()), pa.array(raw, pa.binary())], names=list("abcd"))
    parts = list(neardup._regions(iter([batch]), 64))
    assert all(len(ids) <= 64 for _, ids, _, _ in parts) and sum(len(ids) for _, ids, _, _ in parts) == n + len(parts) - 1
    assert {(a, b) for _, ids, _, _ in parts for a, b in zip(ids, ids[1:])} == {(k, k + 1) for k in range(n - 1)}


def test_template_family_writes_few_rows(spark):
    """300 texts of one template, just below the threshold to each other: candidates and links stay linear, and none is lost."""
    r = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(5000)])
    base = r.choice(words, 112)

    def changed(text, n):
        own = text.copy()
        own[3 * r.choice(np.arange(1, 37), n, replace=False)] = r.choice(words, n)
        return " ".join(own)

    texts = [changed(base, 2) for _ in range(300)]
    sets = [neardup.shingle_set(t.encode(), 3) for t in texts]
    best = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if best[a] != best[b] and neardup.reaches(sets[a], sets[b], 85):
                low, high = sorted((best[a], best[b]))
                best = [low if x == high else x for x in best]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark, docs, 3, 85, "family").collect()}
    assert got == dict(enumerate(best))
    import glob

    root = max(glob.glob(neardup_root(spark) + "/quillon-family-*"), key=lambda p: __import__("os").stat(p).st_mtime)
    assert spark.read.parquet(f"{root}/tried").count() <= 2 * len(texts) and spark.read.parquet(f"{root}/candidates").count() <= 45 * len(texts)
    assert spark.read.parquet(f"{root}/joining").count() <= 20 * len(texts)


def test_rows_without_links_move_no_sets(spark):
    """100 texts that share half of their words: they meet in mixed regions, but neither sets nor finer signatures of them are written."""
    import glob

    shared = " ".join(f"s{k}" for k in range(60))
    texts = [f"{shared} " + " ".join(f"own{n}_{k}" for k in range(55)) for n in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(x.doc_id == x.component_id for x in neardup.near_duplicates(spark, docs, 3, 85, "apart").collect())
    root = max(glob.glob(neardup_root(spark) + "/quillon-apart-*"), key=lambda p: __import__("os").stat(p).st_mtime)
    assert spark.read.parquet(f"{root}/mixed").select("doc").distinct().count() > 50
    assert spark.read.parquet(f"{root}/full").count() < 10


def test_units_are_found_by_columns(monkeypatch):
    """Units of words are those of a dictionary and zlib's crc32 of the last bytes, but no Python step is taken for each word."""
    r = np.random.default_rng(4)
    words = list(dict.fromkeys(bytes(r.integers(97, 105, n, dtype=np.uint8)) for n in r.integers(0, 7, 600)))
    u = lbl.Units(words[:200], np.ones(200), 150, 32, np.zeros(32**2 - 150))
    rank = {w: k for k, w in enumerate(words[:200])}
    want = [rank[w] if rank.get(w, 150) < 150 else 150 + zlib.crc32(w[-3:]) % (32**2 - 150) for w in words]

    def refused(*_):
        raise AssertionError("a step for each word")

    monkeypatch.setattr(lbl.zlib, "crc32", refused)
    import pyarrow as pa

    found, units = u.of(pa.array([b"cut", *words], pa.binary()).slice(1))
    assert units.tolist() == want and found.tolist() == [rank.get(w, -1) for w in words]
    assert u.of(pa.array(words, pa.binary()), owned=True)[1].tolist() == want and u.of(pa.array([], pa.binary()))[1].tolist() == []


def test_trainer_step_is_the_plain_one():
    """One noise-contrastive step with AdaGrad, output by output."""
    r = np.random.default_rng(5)
    n = 32**2
    shares = r.dirichlet(np.ones(n))
    units, past = r.integers(0, n, 300), [r.integers(0, n, 300) for _ in range(lbl.CONTEXT)]
    begin = lbl.start(shares)
    t = lbl.Trainer(begin, shares, 3)
    t.step(units, past)
    draws, scale = np.random.default_rng(3), 64 / 300
    R, A, Q, b = (x.astype(float) for x in (begin.R, begin.A, begin.Q, begin.b))
    h = sum(R[p] * a for p, a in zip(past, A))
    dh, gQ, gb = np.zeros_like(h), np.zeros_like(Q), np.zeros_like(b)
    for (cumulative, log_noise, offset, k), y in zip(t.sets, (units, units // 32)):
        drawn = np.minimum(np.searchsorted(cumulative, draws.random(k)), len(cumulative) - 1)
        for places, sign in ((np.stack([np.arange(300), y]), -1), (np.stack([np.repeat(np.arange(300), k), np.tile(drawn, 300)]), 1)):
            i, o = places[0], places[1] + offset
            x = (h[i] * Q[o]).sum(axis=1) + b[o] - log_noise[places[1]]
            g = sign * scale / (1 + np.exp(-sign * x))
            np.add.at(gQ, o, g[:, None] * h[i])
            np.add.at(gb, o, g)
            np.add.at(dh, i, g[:, None] * Q[o])
    gR = np.zeros_like(R)
    for p, a in zip(past, A):
        np.add.at(gR, p, dh * a)
    for got, x, g in ((t.m.Q, Q, gQ), (t.m.b, b, gb), (t.m.R, R, gR)):
        assert np.allclose(got, x - 0.06 * g / np.sqrt(1e-3 + g * g), atol=2e-5)


def neardup_root(spark):
    from quillon.llm.common import shared_folder

    return shared_folder(spark).removeprefix("file://")


def test_text_ids(spark):
    """Ids that are texts keep their order."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("b", text), ("a9", text + " x"), ("c", "alone here now"), (None, text), ("d", None)], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in neardup.near_duplicates(spark, docs, 3, 85).collect())
    assert got == [("None", None), ("a9", "a9"), ("b", "a9"), ("c", "c"), ("d", "d")]


def test_classifier_learns(spark):
    got = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and got["score"].between(0, 1).all()
    x = np.random.default_rng(1).normal(size=(500, 4))
    model = gbt.fit(x, (x[:, 1] > 0.3).astype(float), trees=20)
    assert ((model.score(x) > 0.5) == (x[:, 1] > 0.3)).mean() > 0.98


def test_model_is_normalised():
    r = np.random.default_rng(1)
    n = 40**2
    m = lbl.start(r.dirichlet(np.ones(n)))
    m.Q += r.normal(0, 0.3, m.Q.shape).astype(np.float32)
    past = np.array([5, 9, 70])
    units = np.concatenate([np.append(past, u) for u in range(n)])
    logs = m.log_probabilities(units, np.tile(np.arange(4), n), 0)[3::4]
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), lbl.END]


def test_tokens():
    import pyarrow as pa

    texts = ["", None, "  One two\tTWO \x0bthree\n", "É é\u00a0x", " "]
    (_, words, index, sizes), = lbl.tokens(pa.array(["skip", *texts]).slice(1))
    flat, at = [words[int(k)].as_py() for k in index], 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert flat[at : at + n] == lm_tokens(t)
        at += n


def test_scores_against_brute_force(spark):
    """The head has few words, so that all three ways to a count are taken; probabilities are summed one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, None), (-2, "never seen words zzz the"), (-3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    head = lbl.HEAD
    try:
        lbl.head_of.__defaults__ = (300,)
        scores, info = lbl.language_model_scores(spark, df, F.col("doc_id") % 3 > 0, ["doc_id"])
        got = {x.doc_id: x for x in scores.collect()}
    finally:
        lbl.head_of.__defaults__ = (head,)
    u, m = info["units"], info["model"]
    c = Counter(w for i, t in rows if i % 3 > 0 and i > 0 for w in lm_tokens(t))
    assert len(u.words) <= 300 and info["N"] == sum(c.values()) and info["V"] == len(c)
    rank = {w: k for k, w in enumerate(u.words[: u.own])}
    unit = lambda w: rank[w] if w in rank else u.own + zlib.crc32(w[-lbl.SUFFIX :]) % u.suffixes
    within = {}
    for w, n in c.items():
        if w not in rank:
            a, b = within.get(unit(w), (0, 0))
            within[unit(w)] = a + n, b + 1
    q, b, n = m.Q.astype(float), m.b.astype(float), u.side**2
    for i, t in rows:
        past, total = [unit(lbl.END)] * lbl.CONTEXT, 0.0
        for w in lm_tokens(t):
            y = unit(w)
            h = sum(m.R[p].astype(float) * m.A[k] for k, p in enumerate(reversed(past[-lbl.CONTEXT :])))
            kind = y // u.side
            for out, own in ((slice(n, None), kind), (slice(kind * u.side, (kind + 1) * u.side), y % u.side)):
                e = np.exp(q[out] @ h + b[out])
                total += np.log10(e[own] / e.sum())
            if w not in rank:
                a, v = within.get(y, (0, 0))
                total += np.log10((c[w] + 0.5) / (a + 0.5 * (v + 1)))
            past.append(y)
        assert got[i].score == pytest.approx(total, abs=1e-3 * len(lm_tokens(t))) and got[i].n_known == sum(c[w] > 0 for w in lm_tokens(t))


def test_partitions_make_no_difference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50).cache()
    a, b = ({x.doc_id: x.score for x in lbl.language_model_scores(spark, d, F.lit(True), ["doc_id"])[0].collect()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_every_word_has_a_unit_and_large_bands_are_cut(spark):
    words = spark.createDataFrame([(f"w{k:05}".encode(), 5) for k in range(4000)] + [(b"top", 9), (b"x" * 99, 50)], "word binary, c bigint")
    top = lbl.head_of(words, 1000)
    assert 900 < len(top) <= 1000 and bytes(top[0]["word"]) == b"top" and all(len(r["word"]) <= lbl.LONGEST for r in top)
    assert [lbl.side_of(v) for v in (0, 10**6, 10**12)] == [32, 100, 512]


def test_base_scores(spark):
    got = QUERIES["op7_language_model"](spark, SF).toPandas().set_index("doc_id")
    rows = {r.doc_id: lm_tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = Counter(w for i, ws in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in rows.items():
        r = got.loc[i]
        assert r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws) and r.train_tokens == n
        assert abs(r.base_score - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
    assert got["score"].sum() > got["base_score"].sum()
