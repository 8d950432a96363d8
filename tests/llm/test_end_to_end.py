"""The pipeline's rows against a plain version of every stage, coded blocks' digests against the library, trees against a plain booster."""

import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import bpe, gbt, packing, rans
from quillon.llm.common import Stage

from .test_lines import plain as plain_lines

SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def little(ids):
    return np.array(ids, "<u4").tobytes()


def plain_boost(x, y, trees, depth, bins, rate, smooth, least):
    """Log-odds by a recursive booster that looks at every node, feature and cut one by one."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    start = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), math.log(start / (1 - start)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, out = y - p, p * (1 - p), np.zeros(len(y))

        def grow(rows, level):
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    found = (0.0, None)
                    for e in edges[f]:
                        left = rows[x[rows, f] <= e]
                        right = rows[x[rows, f] > e]
                        if h[left].sum() < least / 4 or h[right].sum() < least / 4:
                            continue
                        gain = g[left].sum() ** 2 / (h[left].sum() + smooth) + g[right].sum() ** 2 / (h[right].sum() + smooth) - g[rows].sum() ** 2 / (h[rows].sum() + smooth)
                        if gain > found[0] + 1e-12:
                            found = (gain, (left, right))
                    if found[0] > best[0] + 1e-12:
                        best = found
            if best[1] is None:
                out[rows] = rate * g[rows].sum() / (h[rows].sum() + smooth)  # noqa: B023
            else:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + out
    return margin


def test_trees_against_a_plain_booster():
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(160, 5)), 1)
    x[:, 3] = x[:, 1]  # equal features: the first one wins
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.normal(size=160) > 0.4).astype(float)
    options = {"trees": 6, "depth": 3, "bins": 16, "rate": 0.2, "smooth": 1.0, "least": 4.0}
    model = gbt.fit(x, y, **options)
    assert np.allclose(model.raw(x), plain_boost(x, y, **options), atol=1e-9)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] >= 0:
                node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return total

    other = r.normal(size=(300, 5))
    assert np.allclose(model.raw(other), [walk(row) for row in other], atol=1e-12) and len(set(model.feature[model.left >= 0])) > 1


def test_statistics_of_texts():
    got = dict(zip(gbt.STATISTICS, gbt.statistics(b"The cat. THE CAT!\n- cat cat cat\n\n1234 |x|")))
    assert got["log_words"] == pytest.approx(math.log1p(10)) and got["log_lines"] == pytest.approx(math.log1p(3)) and got["repeated_neighbours"] == 0.2
    assert got["digits"] == pytest.approx(4 / 41) and got["pipes"] == pytest.approx(2 / 41) and got["bulleted_lines"] == pytest.approx(1 / 3) and got["distinct_words"] == 0.8
    for t in (b"", b" ", b"\n\n", bytes(range(256)), b"x" * 100_000, b"a " * 50_000):
        v = gbt.statistics(t)
        assert len(v) == len(gbt.STATISTICS) and np.isfinite(v).all()


def test_digests(spark, hard, docs):
    both = hard.select("doc_id", "text").unionByName(docs.select((docs.doc_id + 100).alias("doc_id"), "text")).repartition(5)
    blocks, table = rans.write(spark, both, bpe.default_vocabulary(), Stage(spark, "t"), block_ids=3000)
    got = sorted(rans.digests(rans.read(spark, blocks, table)).collect(), key=lambda r: r.start)
    t, at, want = library(), 0, []
    rows = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in both.collect()]
    for i, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, little(r[1]))):
        want.append((i, at, len(ids), zlib.crc32(little(ids))))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def kept_by_near_dedup(rows):
    """Ids of the smallest document of each group of five-word sets with similarity 0.8."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in sets if root(i) == i}


def contaminated(rows, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[min(10, len(w))].add(tuple(w[k : k + 10]))
    return {i for i, t in rows if any(tuple(w[k : k + n]) in s for w in [words(t)] for n, s in windows.items() for k in range(len(w) - n + 1))}


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() over real rows, copies, near copies, repeated passages and benchmark passages equals the stages done one by one."""
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = [r for r in real if r[1] and len(r[1].split()) > 60]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = "\n".join(x for r in good[:3] for x in r[1].split("\n")[:3])
    more = [(1000 + k, r[1], "en", "s", 1) for k, r in enumerate(good[:5])]
    more += [(1100 + k, " ".join(r[1].split()[:-1] + ["other"]), "en", "s", 1) for k, r in enumerate(good[5:15])]
    more += [(1200 + k, f"{r[1]}\n{passage}\n\n{r[1][::-1][:80]}", "en", "s", 1) for k, r in enumerate(good[15:20])]
    more += [(1300 + k, f"{r[1]} {items[k]} {r[1][:50]}", "en", "s", 1) for k, r in enumerate(good[20:24])]
    more += [(1400, None, "en", "s", None), (1401, "", "en", "s", 0)]
    folder = f"{tmp_path}/sf"
    os.mkdir(folder)
    spark.createDataFrame(real + more, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    got = corpus_pipeline.run(spark, folder).toPandas()

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    model = gbt.train(docs, spark.createDataFrame([(int(i), int(q)) for i, q in zip(labels["doc_id"], labels["quality"]) if q == q and zlib.crc32(str(int(i)).encode()) % 4 != 2], "doc_id bigint, quality int"))
    rows = [(r[0], r[1]) for r in real + more if model.score(np.array([gbt.statistics((r[1] or "").encode())]))[0] >= 0.7]
    assert 0 < len(rows) < len(real + more)
    cut = plain_lines(rows)
    rows = [(i, cut.get(i)) for i, t in rows if not (t and cut[i] == "")]
    assert any(cut[r[0]] != r[1] for r in real + more if r[0] in cut)
    keep = kept_by_near_dedup(rows)
    assert len(keep) < len(rows)
    rows = [r for r in rows if r[0] in keep]
    bad = contaminated(rows, items)
    assert bad
    rows = [r for r in rows if r[0] not in bad]

    t = library()
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}
    assert set(got["doc_id"]) == set(want)
    for i, pieces in got.sort_values("piece").groupby("doc_id"):
        ids, at = want[i], 0
        assert pieces["piece"].tolist() == list(range(len(pieces))) and len(pieces) == -(-len(ids) // packing.SIZE)
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(little(ids[at : at + p.length])) and (p.piece == 0 or p.length == packing.SIZE)
            at += p.length
        assert at == len(ids)
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= packing.SIZE and len(used) <= 1.05 * -(-sum(map(len, want.values())) // packing.SIZE) + 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
