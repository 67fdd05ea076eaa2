import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    words = ["the", "und", "Straße", "naïve", "token", "日本", "x" * 40, "don't", "42", "—"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [
        (1, "the cat sat on the mat and the dog ran to the house", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "de", None), (5, long, "en", "a"),
        (6, "one two", None, "b"), (7, "one two", "en", "b"), (None, "who am I", "en", "b"), (8, "the cat sat on the mat and the dog ran to the house", "en", "c"),
        (8, "the cat sat on the mat and the dog ran to the house", "en", "c"), (9, "12345 !!! ...", "en", "c"), (10, "a\x00b <|endoftext|> c  d\r\n", "de", "c"), (11, "der Hund und die Katze sind im Haus mit der Maus", "de", "c"),
    ]
    extra = [(*r, len(r[1] or ""), "x", 1, 2, "y", "z", b"q", 5) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, row string, found int, print int, size string, name string, value binary, start int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes frames as the tables of a folder and returns its path."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
