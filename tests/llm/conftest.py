import random

import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "émile", "über", "x", "1,2", " nbsp", "end."]
    rows = [
        (1, "one two three", "en", "a", 13, 9, "k"), (1, "one two three", "en", "a", 13, 9, "k"), (2, None, "en", None, None, None, None),
        (3, "", None, "b", 0, 1, "z"), (None, "null id here", "de", "b", 12, None, "z"), (4, " \n\t ", "de", "", 4, 2, "y"),
        (5, "tailé \U0001f600 <|endoftext|> done", "fr", "c", 5, 3, "y"),
        (6, " ".join(rng.choice(words) for _ in range(60000)), "en", "a", 0, 0, ""),
    ]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))), "en", rng.choice(["a", "a", "a", "b", None]), 0, i, "s") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, source_key string")
