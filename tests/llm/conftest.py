import random

import pytest

WORDS = [f"w{i}" for i in range(60)]
EXTRA = "row string, tokens long, weight double, shard int, slot long, law string, lang_pred string, score double, component_id long, _id long, sampled boolean, text_sha256 string, spans string"


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text, lang, source, n_chars): nulls, blanks, a very long text, ties and repeated rows."""
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    long = say(30000)
    a = say(80)
    return [
        (1, a, "en", "s0", 9), (1, a, "en", "s0", 9), (2, a, "fr", "s1", None), (3, a + " tail", "en", None, 9), (4, None, "en", "s0", None), (5, "", None, "s0", 0), (6, " \n\t ", "en", "s0", 4), (7, "12 34 !?", "en", "s0", 8),
        (8, long, "en", "s0", 9), (9, long + " more", "en", "s1", 9), (10, "é" * 70 + " token=ABCDEFGHIJKL1234 deadbeefdeadbeef", "fr", "s1", 9), (11, "All rights reserved. CC BY 4.0", "en", "s0", 9),
        (None, a, "en", "s0", 9), (None, None, None, None, None), (12, "x", "en", "s0", 1), (13, "\u0000 odd \U0001f600 " + say(20), "de", "s2", 9), (14, say(200), "de", "s2", 9), (15, say(200), "fr", "s3", 9),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(messy_rows, SCHEMA)
    return d.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
