import pytest

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s0", 66),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s0", 66),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it", "en", "s0", 66),
    (3, None, None, None, None),
    (4, "", "en", "s1", 0),
    (5, " \t\n ", "en", "s1", 4),
    (None, "no id here", "en", "s1", 10),
    (7, "x" * 70_000, "en", "s0", 70_000),
    (8, "lorem ipsum dolor " * 4000, "en", "s0", 72_000),
    (9, "日本語 テキスト é ü 🙂  two  spaces\r\nand more", "ja", "s2", 40),
    (10, "idiot " * 3 + "you are a moron", "en", "s0", 33),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of the operators."""
    rows = [(*r, 1, "fp") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, fp string")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
