"""Vector codes, importance resampling and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import importance, pii, vectorcodes

from .conftest import HARD


def plain_codes(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 4 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, labels = [], Counter()
    for i, v, c in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c])
        labels[c] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), code, e, labels[c], digest) for i, code, e, c in out)


def vectors(n, width=8):
    r = random.Random(5)
    rows = [(k, [r.choice([-0.5, 0.25, r.uniform(-2, 2)]) for _ in range(width)], r.choice([0, 1, None])) for k in range(n)]
    rows += [rows[3], rows[3], (n, None, 1), (n + 1, [], 1), (n + 2, [0.1] * 7, 1), (n + 3, [None] + [0.1] * 7, 1), (n + 4, [float("nan")] * 8, 1), (n + 5, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None), (n + 6, [0.5] * 12, 1)]
    return rows + [(1000 + k, [0.75] * width, 3) for k in range(60)]


@pytest.mark.parametrize("n", [5, 300])
def test_vector_codes(spark, tmp_path, n):
    rows = vectors(n)
    spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, pos int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.op11_vector_codes(spark, str(tmp_path)).collect())
    assert got == plain_codes(rows)


def test_vector_codes_without_rows(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 2)], "vec_id bigint, embedding array<float>, label int")
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectorcodes.op11_vector_codes(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    large = spark.createDataFrame([(1, [3e6] * 4, 2)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        vectorcodes.encode(spark, large)


def test_nearest_in_floats_and_integers():
    import numpy as np

    r = np.random.default_rng(3)
    for size in (1000, 2**29):
        rows, book = r.integers(-size, size, (50, 4)), r.integers(-size, size, (9, 4))
        book[5] = book[2]
        codes, errors = vectorcodes.nearest(rows, book)
        every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in book] for x in rows]
        assert codes.tolist() == [d.index(min(d)) for d in every] and errors.tolist() == [min(d) for d in every]


def plain_importance(docs, target):
    def buckets(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return len(w), [zlib.crc32(f) % 10000 for f in w + [a + b" " + b for a, b in zip(w, w[1:])]]

    every = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in buckets(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in s}
    rows = []
    for i, w, f in every:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w])
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    out = [(*r[:4], k + 1 if k < 25 * len(drawn) // 100 else None) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in rows if r[4] < 20]
    return sorted(map(str, out))


def test_importance(spark, tmp_path, hard, docs, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_FEATURES", 30_000)
    both = hard.select("doc_id", "text").unionByName(docs.select((docs.doc_id + 100).alias("doc_id"), "text"))
    both.withColumn("score", both.text).withColumn("block", both.doc_id).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    target = ["Beta gamma THE and é", None, "", "the the long long words"]
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = importance.op12_importance_resampling(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_importance([tuple(r) for r in both.collect()], target)
    assert max(r["rank"] or 0 for r in got) > 10


def test_importance_with_small_blocks(spark, hard, monkeypatch):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    want = sorted(map(str, importance.weights(spark, hard, target).collect()))
    monkeypatch.setattr(importance, "BLOCK_DOCS", 2)
    monkeypatch.setattr(importance, "PER_LOT", 1)
    assert sorted(map(str, importance.weights(spark, hard, target).collect())) == want


def test_importance_without_rows(spark, hard, empty):
    target = spark.createDataFrame([], "text string")
    assert importance.draw(spark, importance.weights(spark, empty, target)).count() == 0
    assert importance.draw(spark, importance.weights(spark, hard, target)).count() == len(HARD)


SEEDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
]


def plain_seeds(text):
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(SEEDS) for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group())))


TRICKY = [
    "a@b.co_x@d.com a@b c@@d.e x@y.z. (q@r.s)", "a@b" + ".c" * 3000, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111  1111 1111", "79927398713 00000000000000 4" * 3,
    "+1 (279) 555-0024 190.137.223.204 +4930123456.7) +1--", "é😀 +1 (279) 555-0024é", "+" * 2000 + "1 555 123 4567", "9" * 20_000, "a" * 20_000 + "@", "1 " * 5000, "", None, "@ @. .@.", "x@-.-", "%@a.b",
]


def test_seeds(spark, tmp_path, hard):
    rows = [(100 + k, t) for k, t in enumerate(TRICKY)] + [(None, TRICKY[0]), (100, TRICKY[0])] + [(i, t) for i, t in HARD]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, kind string, row int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op13_personal_data(spark, str(tmp_path)).collect()
    want = sorted((str(i), hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in plain_seeds(t)).encode()).hexdigest(), *(sum(x[3] == k for x in plain_seeds(t)) for k in pii.KINDS)) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    assert all(not r.spans or [int(x.split(":")[1]) for x in r.spans.split(",")] == sorted(int(x.split(":")[1]) for x in r.spans.split(",")) for r in got)


def planted():
    """Documents in which seeds and identifiers that no kind describes share a context, and clean ones; (rows, hidden, clean ids)."""
    r, rows, hidden = random.Random(1), [], {}
    text = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "magna", "erat"]) for _ in range(n))
    for i in range(40):
        seed = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        other = f"555-{r.randint(100, 999)}-{r.randint(1000, 9999)}"
        rows.append((i, f"{text(9)}. You can reach me at {other if i % 2 else seed}, {text(4)} in 2019 code 12345."))
        if i % 2:
            hidden[i] = ("phone", other)
    for i in range(40, 60):
        rows.append((i, f"{text(5)}\nE-mail: {f'user{i}@mail.example.com' if i % 4 else f'user{i}@intranet'}\n{text(3)}"))
        if i % 4 == 0:
            hidden[i] = ("email", f"user{i}@intranet")
    rows += [(i, f"{text(8)} in 2019 code 12345 and version 1234-5 {text(3)}") for i in range(60, 80)]
    rows += [(i, rows[1][1]) for i in range(80, 120)]  # copies of one hidden number
    hidden |= {i: hidden[1] for i in range(80, 120)}
    return rows, hidden


def plain_patterns(rows, rounds=3):
    """The patterns of texts without seeds or candidates beside each other's contexts."""
    words = lambda t: re.findall("[a-z:=#]+", t.lower())
    totals, links = Counter(), Counter()
    for _, t in rows:
        w = words(t)
        totals.update(" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        seeds = plain_seeds(t)
        places = [[(a, b, n) for a, _, b, n in seeds if n == k] for k in pii.KINDS]
        found = [(m.start(), m.end(), None) for m in re.finditer(r"[A-Za-z0-9_%+@()./#-]*[0-9@][A-Za-z0-9_%+@()./#-]*(?: [0-9(+][0-9().+/-]*)*", t)]
        trimmed = [(a, b - (t[b - 1] == "."), n) for a, b, n in found]
        near = [x for x in trimmed if (len(re.findall("[0-9]", t[x[0] : x[1]])) >= 4 or "@" in t[x[0] : x[1]] or len(re.findall("[A-Za-z0-9]", t[x[0] : x[1]])) >= 5) and not any(a < x[1] and x[0] < b for a, _, b, _ in seeds)]
        for own, every in [(p, p) for p in places] + [(near, found)]:
            for a, b, kind in own:
                before = words(t[max((e for _, e, _ in every if e <= a), default=0) : a])[-3:]
                behind = words(t[b : min((s for s, _, _ in every if s >= b), default=len(t))])[:3]
                value = re.sub("[^a-z0-9@]", "", t[a:b].lower())
                for g in {("before", " ".join(before[-n:])) for n in (1, 2, 3) if len(before) >= n} | {("behind", " ".join(behind[:n])) for n in (2, 3) if len(behind) >= n}:
                    links[g, value, kind] += 1
    edges = Counter()
    for (g, v, _), n in links.items():
        edges[g, v] += n
    seeds = {(v, k): 1.0 for _, v, k in links if k}
    of = defaultdict(list)
    for (g, v), n in edges.items():
        of[g].append((v, n))
    trust = seeds
    for _ in range(rounds):
        scores = {}
        for g, vs in of.items():
            for k in pii.KINDS:
                mass = sum(trust.get((v, k), 0) for v, _ in vs)
                total = max(totals[g[1]], sum(n for _, n in vs))
                if len(vs) >= 3 and round(mass, 9) >= 3:
                    scores[g, k] = round(sum(n * trust.get((v, k), 0) for v, n in vs) / total, 9)
        trust = dict(seeds)
        for (g, k), c in scores.items():
            for v, _ in of[g]:
                if (v, k) not in seeds:
                    trust[v, k] = max(trust.get((v, k), 0), c)
    return {(g[0], g[1], k): c for (g, k), c in scores.items() if c >= 0.5}


def test_contexts_find_hidden_identifiers(spark):
    rows, hidden = planted()
    df = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id bigint, text string").repartition(3)
    ids, spans, patterns = pii.extract(spark, df)
    text = dict(rows)
    added = {r.doc_id: (r.kind, text[r.doc_id][r.start : r.end]) for r in spans.where("NOT base").join(ids, "row").collect()}
    assert added == hidden
    assert ids.count() == len(rows) + 2
    got = {(r.side, r.gram, r.kind): r.confidence for r in patterns.collect()}
    assert ("before", "reach me at", "phone") in got and got == pytest.approx(plain_patterns(rows))


def test_contexts_with_a_full_filter(spark, monkeypatch):
    """With one slot every run of words reaches the join: same patterns."""
    rows, _ = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(str, pii.extract(spark, df)[2].collect()))
    monkeypatch.setattr(pii, "SLOTS", 1)
    assert sorted(map(str, pii.extract(spark, df)[2].collect())) == want


def test_personal_data_without_rows(spark, empty):
    ids, spans, patterns = pii.extract(spark, empty)
    assert ids.count() == spans.count() == patterns.count() == 0
