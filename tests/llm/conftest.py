import pytest

SF = "/root/testdata/sf0.001"

#: Rows that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
    (2, "the quick brown fox jumps over the lazy dog", "en", "b", 2),
    (3, "", "en", "a", 3),
    (4, None, None, None, None),
    (5, "x" * 5000 + " " + "word " * 3000, "en", "a", 5),
    (6, "one", "en", "b", 6),
    (6, "one", "en", "b", 6),
    (7, " \t\n ", "en", None, 7),
    (8, "password=hunter2xyz mail a.b@c.de call +1 (555) 123-4567 at 10.0.0.1 card 4111 1111 1111 1111", "en", "c", 8),
    (9, "éàü 漢字 😀 naïve", "fr", "c", 9),
    (None, "no id here", "en", "b", 0),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, i, "z", 0, 1.5) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, size int, kind string, _w int, target double")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
