import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "spruce", "willow", "yew", "é", "straße"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "n", "s"]) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, white space alone, ties, repeated rows."""
    copy = prose(1, 120)
    return [
        (1, copy, "en", "a", 1), (2, copy, "en", "a", 1), (2, copy, "en", "a", 1), (3, copy.upper(), "de", "b", 1), (4, prose(2, 60_000), "en", "a", 1),
        (5, None, "en", "a", None), (6, "", "en", None, 0), (7, " \n\t \n", None, "a", 1), (None, prose(3, 90), "en", "a", 1), (None, None, None, None, None),
        (8, "one", "en", "a", 1), (8, "one two", "en", "a", 1), (9, "\n".join([prose(4, 30), prose(5, 30), "", prose(6, 30)]), "en", "a", 1),
        (10, "\n".join(["before", prose(4, 30), prose(5, 30), prose(6, 30), "after"]), "en", "a", 1), (11, "\n".join([prose(7, 25)] * 9), "en", "a", 1),
        (12, "a  b \x1c c\x85d", "en", "a", 1), (13, "x" * 5000, "en", "a", 1), (14, "😀 😀 字字 \x0b z", "en", "a", 1),
    ]


@pytest.fixture()
def odd(spark, odd_rows):
    """Those rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("digest", "fp", "key", "w", "root", "size", "slot", "stratum", "kept", "rules", "piece", "row", "start", "spans", "item_id", "c", "own_id", "deleted")])


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
