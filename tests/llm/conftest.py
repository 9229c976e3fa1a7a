from __future__ import annotations

import random

import pytest
from llm_data import CLASHING, prose

@pytest.fixture
def r() -> random.Random:
    return random.Random(7)


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and other columns that clash."""
    r = random.Random(3)
    rows = [
        (1, "plain words about rivers and stones.", "en", "a", 36), (1, "plain words about rivers and stones.", "en", "a", 36), (2, None, "en", "a", None),
        (3, "", "en", None, 0), (4, "   \n \t ", None, "b", 7), (None, "a text without a number, yet with words", "en", "b", 1), (5, prose(r, 40000), "en", "a", 1),
        (6, "x" * 50000, None, None, None), (7, "!!! ??? ...", "en", "a", 1), (8, "日本語 のテキスト 😀\u0000 end", "ja", "c", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*x, "k", "s", 1, 0.5, "t", "p", 3, 4, "b", "r", "z") for x in rows], CLASHING)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)
