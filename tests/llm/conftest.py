import pytest
from helpers_llm import frame, words


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, and passages that repeat."""
    passage = words(900, 60, 5000)
    rows = [
        (None, "no id " + words(1, 50), "en", "a"),
        (None, None, None, None),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (5, " \t\n", None, "b"),
        (6, "one", "en", None),
        (7, words(2, 300) + " " + passage + " " + words(3, 40), "en", "c"),
        (8, words(4, 40) + "\n" + passage + "\n" + words(5, 90), "de", "c"),
        (9, words(6, 200), "en", "a"),
        (9, words(6, 200), "en", "a"),
        (10, words(6, 200), "en", "c"),
        (11, words(6, 199) + " changed", "en", "b"),
        (12, (words(7, 50) + " ") * 3, "fr", "b"),
        (13, words(8, 60_000), "fr", "a"),
        (14, "naïve «ÉTÉ» 中文 🙂 " + words(9, 40), "fr", "a"),
        (9, "another text of the same id " + words(10, 60), "en", "a"),
    ]
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
