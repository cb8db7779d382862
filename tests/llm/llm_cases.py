"""Inputs shared by the tests of the llm package."""

import random

import pytest

WORDS = "the of and river stone orchard bridge harvest winter morning paper letter market village road mill".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", ","]) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    long = prose(1, 20_000)
    rows = [
        (1, "Hello the world of  orchard", "en", "src0", 5, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "src1", 0, "y"),
        (None, prose(2, 40), "en", "src0", 1, "z"),
        (None, None, None, None, None, None),
        (4, " \t\n ", "en", "src0", 4, "k0"),
        (5, long, "en", "src0", 9, "block"),
        (6, prose(2, 40), "en", "src2", 1, "z"),
        (6, prose(2, 40), "en", "src2", 1, "z"),
        (7, "é😀▁ a　b\r\nc  \x00d", "fr", "src2", 1, "packed"),
        (8, "one two", "en", "src2", 1, "one"),
        (9, "One TWO", "en", "src2", 1, "two"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, packed string"
    frame = spark.createDataFrame(rows, schema)
    return frame.selectExpr("*", "lang as block", "lang as score", "source as spans", "source as pii", "source as fingerprint")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().toString()
