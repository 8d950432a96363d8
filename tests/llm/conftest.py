import pytest

HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "no id at all in this row"), (8, "x" * 30_000), (9, "w%d " * 10 % tuple(range(10)) + "é ü　日本   <|endoftext|> \x00"), (10, "long " * 20_000), (11, "".join(f"line {chr(97 + k)}\n" for k in range(20)) * 12),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, 2.0, 3) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, start int, score double, n int")


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark, hard):
    """A folder with the hard documents, a benchmark and labels."""
    d = tmp_path_factory.mktemp("sf")
    hard.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, ""), (4, "two words"), (4, "two words"), (None, "one")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (10, 0, 0), (11, None, 0), (99, 1, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def docs(spark):
    """Real rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
