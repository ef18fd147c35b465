import random

import pytest

ODD_TEXTS = [None, "", " ", "\n\t", "a", "The  quick\n\nbrown fox", "ÉCOLE ß İ 日本語 😀", "x" * 5000, "don't WE'LL ½ ² \x00", "<|endoftext|> <s>", "same text here", "same text here"]


@pytest.fixture
def odd(spark):
    """Nulls, empty and odd texts, repeats, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, i, "x", None) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", 0, "x", None), (0, "again the id 0", 0, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, size string, first string").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, size int")


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n))
