from __future__ import annotations

import pytest

DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    # names the operators use themselves
    " _id int, _text string, _key string, _row string, ids string, score string, n int,"
    " _sha string, _salt int, _epochs int, start string, band string, _bucket int"
)
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))


def clash(number: int) -> tuple:
    return (number, "t", "k", "r", "i", "s", number, "h", number, number, "st", "b", number)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, very long and repeated texts, repeated rows."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "src0", 35),
        (2, "alpha beta gamma delta epsilon zeta", "en", "src0", 35),
        (3, "Alpha beta gamma delta epsilon zeta", "de", "src1", 35),
        (3, "Alpha beta gamma delta epsilon zeta", "de", "src1", 35),
        (4, "", "en", "src1", 0),
        (5, None, None, None, None),
        (None, None, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta", "fr", None, 35),
        (6, LONG, "en", "src0", len(LONG)),
        (7, LONG + " end", None, "src0", len(LONG) + 4),
        (8, " \n\t  \n", "en", "src2", 6),
        (9, "x" * 70_000, "en", "src2", 70_000),
        (10, "one", "en", "src2", 3),
        (11, "été \U0001f600 naïve 你好  two  spaces here", "fr", "src2", 30),
    ]
    return [row + clash(i) for i, row in enumerate(rows)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> whole text of the smallest table."""
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
