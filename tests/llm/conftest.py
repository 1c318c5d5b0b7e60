"""Small documents that hold the edge cases of every operator."""

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta the of und le".split()) + str(rng.randrange(999)) for _ in range(30_000))
    texts = [None, "", " \n\t ", "word", "two words", "The same text of the twins and more.", "The same text of the twins and more.", long, "é😀 ﬁ   x y", "<|endoftext|> a <b"]
    rows = [(i, t, "en", "src", 7, 1, "n", 0.5, "h", -1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, "The same text of the twins and more.", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, id long, t string, score double, h string, row long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 1, 1), (None, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
