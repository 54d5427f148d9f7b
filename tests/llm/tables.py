"""Small awkward tables that the operators are tried on."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, `key` int, `H1` int"


def documents(spark, rows):
    """A documents table with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, g, s, 0, "r", 1, 2) for i, t, g, s in rows], DOCS)


def prose(n, seed=0, words=40):
    """``n`` different texts of made-up words."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tur", "ves", "an", "or", "shi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(words)) for _ in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
