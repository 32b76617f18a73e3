import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")

#: Nulls, blanks, ties, repeated rows and one very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  TWO"), (6, "one two"), (6, "one two"), (7, "alpha beta gamma delta epsilon zeta"),
    (8, "Alpha beta\ngamma  delta epsilon zeta"), (9, "é" * 50 + " ß 漢字 \x85 x"), (10, "w " * 30000), (11, " ".join(f"w{i}" for i in range(9000))), (None, "no id here"), (12, "tie tie tie tie tie tie"),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(k, t, "x", 0) for k, t in ODD], "doc_id long, text string, source string, bucket int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, idx int")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
