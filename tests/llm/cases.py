"""Small tables with the awkward rows that every operator must take."""

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "."]) for _ in range(n))


def awkward():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, letters beyond ASCII and beyond 16 bits."""
    long = prose(1, 4000)
    base = prose(2, 120)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", None, 7), (4, base, "en", "a", None), (5, base, None, "b", 1), (5, base, None, "b", 1),
        (6, base.replace("alpha", "Alpha", 1), "en", "b", 1), (7, long, "de", "c", 1), (8, "É 　𝒳 ünï\x00cödé ÀB", "fr", "c", 1), (None, prose(3, 60), "en", "a", 1), (None, None, None, None, None),
        (9, "one two three", "en", "a", 1), (10, "x " * 300, "en", "a", 1), (11, "same line here\n" * 40, "en", "b", 1), (12, "Word!! ON THE *** ||| $$$ " * 30, "es", "b", 1), (13, "1234567890 4111", None, "d", 1),
    ]
    return rows


def frame(spark, rows, schema=DOC):
    """The rows, with extra columns whose names operators also use."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", "1 as h", "'x' as size", "2 as n_words", "'y' as fp", "true as kept", "1 as seq", "'z' as score", "0 as found")


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)
