import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents, and rows that are odd."""
    rows = [
        (r["doc_id"], r["text"])
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ]
    long = " ".join(f"w{i % 997}x{i // 7}" for i in range(200_000))
    odd = [None, "", " \n ", "a b c", "A  b\tC", "a b c", "one", "one two three four", long, long + " tail", "é" * 50, "  x \x85"]
    return rows + [(1_000_000 + i, t) for i, t in enumerate(odd)]


@pytest.fixture(scope="session")
def docs(spark, documents):
    """``documents`` with extra columns that operators use names like."""
    rows = [(i, t, "x", 1.5, i, "k", 7) for i, t in documents]
    schema = "doc_id long, text string, digest string, score double, row long, key string, n_words long"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
