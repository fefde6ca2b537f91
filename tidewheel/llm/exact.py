"""Exact copies by content sort: range slices, external sort, whole neighbours compared.

A bounded sample gives splitters along (first characters, hash of the text, id).  Rows are
dealt to the slices between splitters and sorted there by their whole normalised text, which
puts equal texts next to each other; a run ends where two neighbours differ in any byte.
Since the id is part of a splitter, a text with very many copies fills several slices
instead of one task.  Only texts that a splitter touches can span slices; one row per such
run is compared again, and there are at most two per slice.

Defined cases: a null text counts as empty, so null and empty texts are copies of each
other.  Null ids sort below all others, and stay only if the text has no other id.  Of rows
that agree in text and id exactly one is kept.  An empty table gives an empty result.
Columns beyond the id and the text are carried through by ``drop_copies`` unchanged, also
if their names clash with result columns.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewheel.llm.tables import count_not_above, partitions, stored, text_or_empty

SAMPLED_PER_SLICE = 32
SLICES_PER_TASK = 4


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ASCII texts take the quicker function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    """
    runs = _runs(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), keep)
    rows = stored(
        runs.select(
            "_id", "_slice", "_first", "_run_keep", "_run_size", "_cut",
            F.sha2("_norm", 256).alias("text_sha256"),
            F.when(F.col("_cut") & F.col("_first"), F.col("_norm")).alias("_norm"),
        ),
        "runs",
    )
    whole = _stitched(rows.where("_cut and _first"), keep)
    whole = whole.drop("_run_keep")
    joined = rows.join(F.broadcast(whole), ["_slice", "text_sha256"], "left")
    keep_id = F.when(F.col("_whole_size").isNull(), F.col("_run_keep")).otherwise(F.col("_whole_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_whole_size", "_run_size").alias("group_size"),
        (F.col("_first") & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    packed = docs.select(
        F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"),
        F.struct(*[c for c in docs.columns if c != text_col]).alias("_rest"),
        F.col(text_col).isNull().alias("_was_null"),
    )
    heads = stored(
        _runs(packed, keep)
        .where("_first")
        .withColumn("text_sha256", F.when(F.col("_cut"), F.sha2("_norm", 256)))
        .drop("_norm"),
        "heads",
    )
    edge = heads.where("_cut").withColumn("_norm", lower_ascii(F.col("_text")))
    beaten = _stitched(edge, keep).where("not (_run_keep <=> _whole_keep)").select("_slice", "text_sha256")
    text = F.when(~F.col("_was_null"), F.col("_text"))
    return heads.join(F.broadcast(beaten), ["_slice", "text_sha256"], "left_anti").select(
        *[text.alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns]
    )


def _runs(rows: DataFrame, keep: str) -> DataFrame:
    """``rows`` (_id, _text, ...) with their run: slice, size, id that stays, first or not."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    key = F.struct(
        lower_ascii(F.left(F.col("_text"), F.lit(64))).alias("head"),
        F.xxhash64(F.lower("_text")).alias("h"),
        F.col("_id").alias("id"),
    )
    splitters, count = _splitters(rows, key)
    keyed = rows.withColumn("_key", key)
    if count:
        keyed = keyed.withColumn("_slice", count_not_above(splitters, count, F.col("_key")))
        below, above = (F.get(splitters, F.col("_slice") - 1), F.get(splitters, F.col("_slice")))
        # At either end a neighbour is absent and compares as null.
        touched = F.coalesce(F.col("_key.h") == below["h"], F.lit(False)) | F.coalesce(
            F.col("_key.h") == above["h"], F.lit(False)
        )
        keyed = keyed.withColumn("_cut", touched)
    else:
        keyed = keyed.withColumn("_slice", F.lit(0)).withColumn("_cut", F.lit(False))
    dealt = keyed.drop("_key").repartition("_slice").withColumn("_norm", lower_ascii(F.col("_text")))
    run = W.partitionBy("_slice", "_norm")
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    line = run.orderBy(order)
    all_of = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    best = F.min if keep == "smallest" else F.max
    return dealt.select(
        *[c for c in dealt.columns],
        (F.row_number().over(line) == 1).alias("_first"),
        best("_id").over(all_of).alias("_run_keep"),
        F.count(F.lit(1)).over(all_of).alias("_run_size"),
    )


def _splitters(rows: DataFrame, key: Column) -> tuple[Column, int]:
    """Sorted sample keys that cut the rows into slices, as a literal; and their number.

    At most ``SAMPLED_PER_SLICE`` short keys per slice are gathered.
    """
    slices = SLICES_PER_TASK * partitions(rows)
    total = rows.count()
    if total == 0:
        return F.lit(None), 0
    fraction = min(1.0, SAMPLED_PER_SLICE * slices / total)
    keys = rows.sample(fraction=fraction, seed=17).select(key.alias("k"))
    every = F.transform(
        F.sequence(F.lit(1), F.lit(slices - 1)),
        lambda i: F.get("all", F.floor(i * F.size("all") / slices).cast("int")),
    )
    picked = keys.agg(F.sort_array(F.collect_list("k")).alias("all")).select(
        F.to_json(F.array_distinct(F.filter(every, lambda k: k.isNotNull()))).alias("cuts"),
    )
    cuts = json.loads(picked.first()["cuts"])
    shape = T.ArrayType(keys.schema["k"].dataType)
    return F.from_json(F.lit(json.dumps(cuts)), shape), len(cuts)


def _stitched(edge: DataFrame, keep: str) -> DataFrame:
    """For runs of texts that a splitter touches: the keeper and size over all slices.

    ``edge`` has one row per such run, so at most a few per slice; whole texts are compared.
    """
    best = F.min if keep == "smallest" else F.max
    return (
        edge.groupBy("_norm")
        .agg(
            best("_run_keep").alias("_whole_keep"),
            F.sum("_run_size").alias("_whole_size"),
            F.collect_list(F.struct("_slice", "text_sha256", "_run_keep")).alias("runs"),
        )
        .select("_whole_keep", "_whole_size", F.inline("runs"))
    )
