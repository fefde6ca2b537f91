"""Rows with every awkward case, for all corpus operators."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} Thing{i % 31}" for i in range(30_000))
ROWS = [
    (1, "Hello World, this is the first text.", "en", "a"),
    (2, "hello world, this is the first text.", "en", "a"),
    (2, "hello world, this is the first text.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "b"),
    (7, LONG + " end", "en", "c"),
    (8, "Été À LA ÇA ß 日本語 🙂 İ ΑΣ", "fr", "c"),
    (9, "one two", None, "c"),
    (10, "x" * 5_000, "en", "d"),
    (None, "Hello World, this is the first text.", "en", "a"),
    (None, None, None, None),
    (11, "under the Apache License, and the MIT  license: general public license", "en", "é"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# Names that the operators use inside, as columns of the input.
CLASHES = ["_id", "_text", "slice", "home", "key", "size", "target", "score", "class", "ids", "n", "kept", "_norm", "_row",
           "fingerprint", "toxicity", "prefixes", "digest", "taken", "_doc", "_beaten"]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
