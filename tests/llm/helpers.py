"""Small fixtures shared by the tests of the training-data operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, schema=DOCS):
    """Documents from (doc_id, text[, lang[, source]]) tuples."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, schema)


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties and a long text."""
    long = "alpha beta gamma " * 20_000
    return documents(spark, [
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"),
        (2, "one  two\tthree\nfour five six", None, None), (3, None, None, None), (4, "", "en", ""),
        (5, " \n\t ", "de", "b"), (None, "one two three four five six", "fr", "a"), (None, None, None, None),
        (6, long, "en", "a"), (7, "x", None, "b"), (8, "é ß 漢字 \x00 ½ 😀", "de", None), (9, "1", "en", "c"),
    ])


def clashing(docs):
    """The same documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["n_words", "kept", "digest", "salt", "size", "taken", "target", "score", "quality_rules", "norm",
             "class_id", "ids", "place", "label", "features", "value", "shard"]
    return docs.withColumns({n: F.lit("clash") for n in names})


def prose(seed, n_words, vocabulary=200, prefix="w"):
    rng = random.Random(seed)
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n_words))


def words_of(text):
    return WORDS.findall(text or "")
