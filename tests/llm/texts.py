"""Small tables and brute-force helpers for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, words, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, start=0):
    return frame(spark, [(start + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)])


def rng(seed=5):
    return random.Random(seed)
