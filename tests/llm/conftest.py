"""Small tables: the given documents, and a hand-made one with everything that may go wrong."""

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ignored string, id long, key string, n_words long"


@pytest.fixture(scope="session")
def given_docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def hand_made():
    prose = " ".join(f"word{i % 97}x{i * i % 89} and" for i in range(150))
    other = " ".join(f"term{i % 83}y{i * i % 71} or" for i in range(150))
    rows = [
        (1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (None, None), (None, prose), (None, other + " unique end"),
        (6, prose.replace("word5x25", "changed", 1)), (7, "a b"), (8, "\n\n" + other + "\n" + other), (9, "ÄÖ" + "ß" * 300), (10, "ÄÖ" + "ß" * 300 + "x"),
        (11, "lonely but long enough line\nsecond\nLONELY but long enough line  "), (12, "lonely but long enough line"), (13, "z" * 5000), (14, "!!! ### ***"),
    ]
    return [(i, t, None if k % 3 else "en", None, None, "x", k, None, -1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(hand_made(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
