"""License scan by diagonal voting over rolling word pairs.

Every pair of neighbouring words of every document is joined to the pairs of the license
templates, by hash and by the words themselves.  A match votes for the diagonal
``document position - template position``; matches of one place share a diagonal, and
inserted or missing words move it a little.  Votes are summed per diagonal, diagonals at
most ``BAND`` apart are merged, and a span is verified when enough distinct template
positions are covered.  A span that covers a template on a single diagonal is a literal
copy of it.  The templates are a fixed list, so broadcasting them is bounded; only matches
are shuffled, summed per task first.

Defined cases: a null text counts as empty; no words gives zero places, null positions,
empty labels and score 0.  Rows with equal ids and texts get equal results.  Null ids are
kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewheel.llm.exact import lower_ascii
from tidewheel.llm.tables import stored, text_or_empty

# Phrases that name a license by themselves.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# Opening words of well-known license notices, as words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BAND = 2
COVERED = 0.8


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def template_rows(base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES) -> list[tuple]:
    """(template, label, is_base, pairs, position, pair) for every word pair of every template."""
    rows = []
    for number, (label, phrase) in enumerate([*base, *notices]):
        words = phrase.split()
        for at in range(len(words) - 1):
            rows.append((number, label, number < len(base), len(words) - 1, at, f"{words[at]} {words[at + 1]}"))
    return rows


def _templates(spark: SparkSession, base: Sequence, notices: Sequence) -> DataFrame:
    return spark.createDataFrame(
        template_rows(base, notices),
        "template int, label string, base boolean, pairs int, t_pos int, t_pair string",
    ).withColumn("t_hash", F.xxhash64("t_pair"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Sequence[tuple[str, str]] = BASE,
    notices: Sequence[tuple[str, str]] = NOTICES,
    band: int = BAND,
    covered: float = COVERED,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = stored(_found(rows, _templates(docs.sparkSession, base, notices), band, covered), "found")
    plain = rows.select("_id", F.xxhash64("_text").alias("_h"), F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    match = plain["_id"].eqNullSafe(found["f_id"]) & (plain["_h"] == found["f_h"])
    joined = plain.join(found, match, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("_id").alias(id_col), "n_words",
        F.coalesce("places", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.array_join(F.coalesce("named", none), ",").alias("base_labels"),
        F.array_join(F.coalesce("all_named", none), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def _found(rows: DataFrame, templates: DataFrame, band: int, covered: float) -> DataFrame:
    """Per document with any match: places and labels."""
    words = rows.select("_id", F.xxhash64("_text").alias("_h"), words_of(F.col("_text")).alias("_w"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_w") - 1),
        lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)),
    )
    rolled = words.where(F.size("_w") > 1).select("_id", "_h", F.posexplode(pairs).alias("pos", "pair"))
    hits = rolled.withColumn("hash", F.xxhash64("pair")).join(
        F.broadcast(templates), (F.col("hash") == F.col("t_hash")) & (F.col("pair") == F.col("t_pair"))
    )
    place = ["_id", "_h", "template", "label", "base", "pairs"]
    votes = hits.groupBy(*place, (F.col("pos") - F.col("t_pos")).cast("long").alias("diagonal")).agg(
        F.collect_set("t_pos").alias("seen")
    )
    near = W.partitionBy("_id", "_h", "template").orderBy("diagonal").rangeBetween(-band, band)
    merged = F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(near))))
    spans = votes.select(
        *place, "diagonal",
        (F.size("seen") == F.col("pairs")).alias("literal"),
        (merged / F.col("pairs")).alias("cover"),
    )
    place_of_base = F.col("base") & F.col("literal")
    verified = place_of_base | (~F.col("base") & (F.col("cover") >= covered))
    return spans.groupBy(F.col("_id").alias("f_id"), F.col("_h").alias("f_h")).agg(
        F.count_if(place_of_base).alias("places"),
        F.min(F.when(place_of_base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(place_of_base, F.col("diagonal"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(place_of_base, F.col("label")))).alias("named"),
        F.sort_array(F.collect_set(F.when(verified, F.col("label")))).alias("all_named"),
        F.max("cover").alias("best"),
    )
