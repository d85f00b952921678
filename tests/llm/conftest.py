import duckdb
import pytest

#: Awkward rows every operator over documents must take: nulls, empty, no words, repeats, ties, a long text.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "same text of some six words"), (5, "same text of some six words"), (6, LONG), (7, "é ß x\n\n  y ")]


@pytest.fixture
def odd(spark):
    """Documents with awkward texts and extra columns whose names clash with the operators' own."""
    rows = [(i, t, None, None, 1, "x", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, kept string, length int")


@pytest.fixture
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(sf):
    return dict(duckdb.connect().sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
