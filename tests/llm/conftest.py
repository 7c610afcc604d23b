import random

import pytest

LONG = " ".join(f"w{i}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}q{i * 7 % 13}" for i in range(60))
ITEM = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, shard string, slot string, epoch string, matches string, node string, _kept string, _cuts string"


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text or ""), *["clash"] * 9)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, and columns with clashing names."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(400)]
    prose = [" ".join(rng.choices(words, k=80)) for _ in range(12)]
    rows = [row(None, "some text without an id"), row(None, None), row(1, None), row(2, ""), row(3, " \t\r\n "), row(4, "one"), row(5, "ONE"), row(6, "..."),
            row(7, "Hello World again and again"), row(7, "Hello World again and again"), row(8, "hello\tworld again  and again"), row(9, LONG), row(10, LONG + " end"),
            row(11, prose[0] + " " + PASSAGE + " " + prose[1]), row(12, prose[2] + " " + PASSAGE.upper() + " " + prose[3]), row(13, "before " + ITEM + " after"),
            row(14, ITEM.upper()), row(15, "eleven twelve"), row(16, "é" * 50, None, None), row(17, "été élève naïve", "fr", "s1"), row(18, "short item"),
            row(19, prose[4], "en", "s1"), row(20, prose[4].replace("v", "v", 1) + " tail", "en", "s2"), row(21, prose[5], "en", None), row(22, prose[5] + " " + prose[5]),
            (None,) * 14]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
