"""Small tables with the odd rows that every operator must handle."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the cat sat on the mat and looked at the dog\nA shared line of text\nlast", "en", "a", 1),
    (2, "the cat sat on the mat and looked at the dog\n  a SHARED line of text\t\nother", "en", "a", 1),
    (2, "the cat sat on the mat and looked at the dog\n  a SHARED line of text\t\nother", "en", "a", 1),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "   \n\t\n", "fr", "b", 6),
    (None, "no name here\nA shared line of text", None, "c", None),
    (6, "un", "fr", "c", 2),
    (7, "1234 5678 !!", None, "c", 12),
    (8, "le chat est sur la table et regarde le chien " * 400, "fr", "d", 18000),
    (9, "x" * 5000 + " émoji 😀 <|endoftext|> fin", "fr", "d", 5030),
    (10, "der Hund und die Katze\nÄÖÜ lange Zeile im Text", "de", "d", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
