"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator gives a defined result."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, decontam, gbt, lbl, linededup, neardup, packing, rans, rules, suffixdedup, wordpiece
from quillon.llm.common import Stage
from quillon.llm.registry import ORACLES, QUERIES

from .conftest import HARD

N = len(HARD)


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] + ["pipeline"] and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op10_best_fit_packing", "op11_vector_codes", "pipeline")])
def test_one_row_a_document(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) == N
    assert sorted(map(str, got["doc_id"].astype("Int64"))) == sorted("<NA>" if i is None else str(i) for i, _ in HARD)


def test_rules(hard, empty):
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(hard)).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and not got[1].kept
    assert got[10].n_words == 20_000 and got[10].n_repeat_words == 20_000 and got[8].word_chars == 30_000
    assert rules.ledger(empty).count() == 0
    table = rules.ablation(rules.ledger(hard)).collect()
    assert [r.policy for r in table] == [p.version for p in rules.POLICIES] and all(r.docs == N for r in table)
    base = table[0]
    assert base.removed == sum(1 for r in rules.ledger(hard).collect() if r.fail_bits & rules.BASE) and base.only_short + base.only_repeated_words <= base.removed


def test_classifier(spark, hard, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = gbt.train(hard, labels)
    assert {r.score for r in gbt.score(hard, model, ["doc_id"]).collect()} == {0.5}
    assert gbt.score(empty, model, ["doc_id", "word", "score"][:2]).count() == 0


def test_rans_round_trip(spark, hard, empty):
    voc = bpe.default_vocabulary()
    blocks, table = rans.write(spark, hard, voc, Stage(spark, "t"), block_ids=500)
    got = rans.read(spark, blocks, table).orderBy("start").collect()
    t = bpe.cached_bpe(voc).tokenizer
    assert len(got) == N and [r.doc_id for r in got] == sorted((i for i, _ in HARD), key=lambda i: (i is not None, i))
    texts = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in HARD)
    import numpy as np

    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == texts
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    blocks, table = rans.write(spark, empty, voc, Stage(spark, "t"))
    assert rans.read(spark, blocks, table).count() == 0


def test_near_duplicates(spark, hard, empty):
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark, hard, 3, 85).collect()}
    assert (7, 6) in got and (6, 6) in got and (None, None) in got and (1, 1) in got and (2, 2) in got
    assert neardup.near_duplicates(spark, empty).count() == 0


def test_lines(spark, hard, empty):
    got = linededup.dedup_lines(spark, hard)
    assert got.count() == N and set(hard.columns) <= set(got.columns)
    one = {r.doc_id: r.text for r in got.collect()}
    assert one[1] is None and one[2] == "" and len(one[11]) < len(HARD[-1][1]) and one[8] == "x" * 30_000
    assert linededup.dedup_lines(spark, empty).count() == 0


@pytest.mark.parametrize("literals", [decontam.LITERALS, 0])
def test_decontamination(spark, sf, hard, empty, literals):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in decontam.contamination(spark, hard, bench, literals=literals).collect()}
    assert got[6].n_hit == 10 and got[6].n_items == 1 and got[6].contaminated and got[5].n_hit == 2 and not got[1].contaminated and got[1].n_words == 0 and not got[4].contaminated
    assert not any(r.contaminated for r in decontam.contamination(spark, hard, bench.limit(0), literals=literals).collect())
    assert decontam.contamination(spark, empty, bench, literals=literals).count() == 0


@pytest.mark.parametrize("literals", [decontam.LITERALS, 0])
def test_decontamination_without_id(spark, sf, literals):
    docs = spark.createDataFrame([(None, HARD[5][1]), (None, "no id and clean"), (1, "clean")], "doc_id bigint, text string")
    got = decontam.contamination(spark, docs, spark.read.parquet(f"{sf}/benchmark.parquet"), literals=literals).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items, r.contaminated) for r in got) == [("1", 0, 0, False), ("None", 0, 0, False), ("None", 10, 1, True)]


def test_language_model(spark, empty, hard):
    scores, totals = lbl.language_model_scores(spark, empty, F.lit(True), ["doc_id"])
    assert scores.count() == 0 and totals["N"] == 0
    scores, totals = lbl.language_model_scores(spark, hard, F.lit(False), ["doc_id", "word"])
    got = scores.collect()
    assert len(got) == N and totals["N"] == 0 and all(r.score <= 1e-9 and r.n_known == 0 for r in got)


def test_suffixes(spark, hard, empty):
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(spark, hard).collect()}
    assert got[8].n_removed == 30_000 and got[10].n_removed == got[10].n_bytes and got[1].n_bytes == 0 and got[6].n_removed == 0
    assert suffixdedup.remove_repeats(spark, empty).count() == 0


def test_token_counts(hard, empty):
    got = {r.doc_id: r for r in wordpiece.token_counts(hard, bpe.default_vocabulary()).collect()}
    assert got[1].n_tokens == 0 and got[5].n_words == 2 and got[10].n_tokens == 20_000 * (got[10].longest_word)
    assert wordpiece.token_counts(empty, bpe.default_vocabulary()).count() == 0


def test_packing(spark, hard, empty):
    got = packing.pack_documents(spark, hard, bpe.default_vocabulary()).toPandas()
    assert got.groupby("doc_id", dropna=False)["length"].sum().min() >= 1 and len(got[got["doc_id"] == 10]) > 10
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows["offset"].to_numpy() == rows["length"].cumsum().shift(fill_value=0).to_numpy()).all() and rows["length"].sum() <= packing.SIZE
    t = bpe.cached_bpe(bpe.default_vocabulary()).tokenizer
    import numpy as np

    ids = np.array(t.encode(HARD[5][1], add_special_tokens=False).ids + [2], "<u4")
    assert got[got["doc_id"] == 6]["ids_crc32"].tolist() == [zlib.crc32(ids)]
    assert packing.pack_documents(spark, empty, bpe.default_vocabulary()).count() == 0


def test_pipeline_stages(spark, sf, hard, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    left = {}
    for name, f in corpus_pipeline.STAGES:
        for table in (hard, empty):
            rows = (out := f(spark, table, sf)).collect()
            if name != "best_fit_packing":
                assert out.columns == corpus_pipeline.COLUMNS and len(rows) <= N
            assert bool(rows) == (table is hard)
            if rows:
                left[name] = {r.doc_id for r in rows}
    assert {6, None, 1, 2} <= left["near_dedup"] and 7 not in left["near_dedup"]
    assert 6 not in left["benchmark_decontamination"] and 5 not in left["benchmark_decontamination"] and {1, 2, 3, 4, None, 10} <= left["benchmark_decontamination"]
    assert left["line_dedup"] == {i for i, _ in HARD}
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_repeated_ids_keep_other_texts(spark):
    texts = ["red green blue black white grey", "one two three four five six seven", "one two three four five six seven", ""]
    rows = [(5, t, "en", "s", len(t)) for t in texts] + [(6, texts[1], "en", "s", 3), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [("5", ""), ("5", texts[1]), ("5", texts[0]), ("None", "x")]
