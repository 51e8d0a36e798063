"""Small tables for the corpus operators: plain ones, and one with every awkward row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward_rows():
    rng = random.Random(4)
    base = prose(rng, 60)
    passage = prose(rng, 55)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one two", "en", "b", 7),
        (5, "one two", "de", None, 7),
        (5, "one two", "de", None, 7),  # a repeated row
        (6, base, "en", "a", 1),
        (7, base, "en", "b", 1),
        (7, prose(rng, 40), "en", "b", 1),  # an id given twice
        (8, base.replace("w", "w", 1) + " tail", "en", "c", 1),
        (9, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "fr", "c", 1),
        (10, prose(rng, 30) + "\n" + passage, "fr", "c", 1),
        (11, prose(rng, 30_000), "en", "a", 1),  # far longer than a sequence
        (12, "naïve über \U0001f600 café, don't. 12.5 <|x|> ###", "en", "c", 1),
        (None, prose(rng, 50), "en", "a", 1),
        (None, base, "en", "a", 1),
        (13, "line one\nline one\nline one\nother\n\n", "en", "a", 1),
        (14, " ".join(["same"] * 50), "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with columns named as the operators name their own."""
    from pyspark.sql import functions as F

    extra = ["input_row", "size", "copies", "target", "node", "class_id", "spans", "kept_text", "probability", "kept", "label", "key", "doc", "at", "rate"]
    return awkward.withColumns({c: F.lit(f"own {c}") for c in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in (1, 2, 4, 5, 6, 7, 8, 9, 13, 14)] + [(None, 1, 0), (6, None, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
