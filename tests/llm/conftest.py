import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows and ids, columns of unlucky names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, base, "a"), (1, base, "a"), (2, base + " lambda", "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"), (None, "no id here", "c"), (6, "x", None), (7, None, None), (8, "word " * 30_000, "a"), (9, base, None), (10, base + "\n" + base, "b"), (2, "other text for the same id", "b")]
    return spark.createDataFrame([(*r, k, "t", 0.5, 1, 2) for k, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long, lang string, score double, size long, copies long")


def same(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="session")
def table_of():
    return same
