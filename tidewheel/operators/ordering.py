"""Exact row numbers, running sums, sliding frames and quantiles without hot tasks.

A plain ``row_number() over (partition by user ...)`` puts every row of a user into
one task.  Here a key that holds very many rows is first cut into consecutive ranges
of its order, so that no task sees more than one range; the ranges are then stitched
together with their row counts.  Ranges are compared in the order columns' own types, so
results equal the plain window for any orderable column, whichever way a key goes.

Inputs are evaluated more than once, so they must be deterministic (a scan, or the
outcome of ``cut_lineage``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewheel.session import cut_lineage, shuffle_partitions

HOT_ROWS = 1_000_000
SAMPLED_PER_RANGE = 32


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows and their counts, as a stored table.

    However large the input, it has fewer than rows / ``hot_rows`` rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return cut_lineage(counts.where(F.col("_rows") > hot_rows))


def range_buckets(
    df: DataFrame, order: Sequence[str], parts: int, active: Column | None = None, rows: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Add an integer column ``_b0`` that never decreases along ``order``.

    A sample of at most about ``SAMPLED_PER_RANGE`` order tuples per range gives the cuts; a
    row's range is the number of cuts that are not above its own tuple, found by binary
    search.  Since whole tuples are compared, a frequent first value is cut by the next
    columns.  ``rows`` is the number of active rows, counted if not given.
    """
    scope = F.lit(True) if active is None else active
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    chosen = df.where(scope)
    rows = chosen.count() if rows is None else rows
    fraction = min(1.0, SAMPLED_PER_RANGE * parts / max(rows, 1))
    sample = chosen.select(place.alias("o")).sample(fraction=fraction, seed=29)
    every = F.transform(
        F.sequence(F.lit(1), F.lit(parts - 1)),
        lambda i: F.get("all", F.floor(i * F.size("all") / parts).cast("int")),
    )
    picked = sample.agg(F.sort_array(F.collect_list("o")).alias("all")).select(
        F.to_json(F.array_distinct(F.filter(every, lambda o: o.isNotNull()))).alias("cuts")
    )
    # A cut may lose digits as text; as a constant it still divides all rows the same way.
    found = json.loads(picked.first()["cuts"] or "[]")
    cuts = F.sort_array(F.from_json(F.lit(json.dumps(found)), T.ArrayType(sample.schema["o"].dataType)))
    steps = [1 << b for b in reversed(range(len(found).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        to = low + width
        return F.when((to <= len(found)) & (F.get(cuts, to - 1) <= place), to).otherwise(low)

    number = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) if steps else F.lit(0)
    return df.withColumn("_b0", F.when(scope, number)), ["_b0"]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running sums along ``order`` within ``keys``; ``totals`` adds whole-key sums.

    ``sums`` maps an output name to a long or double expression; ``totals`` maps an
    output name to one of those sums.  Without keys the whole table is one sequence
    and is always cut into ranges.
    """
    totals = dict(totals or {})
    parts = max(2, shuffle_partitions(df.sparkSession))
    kept = df.columns
    df = df.select("*", *[e.alias(f"_x_{n}") for n, e in sums.items()])

    if keys:
        hot = hot_keys(df, keys, hot_rows)
        hot_total = hot.agg(F.sum("_rows")).first()[0]
        if not hot_total:
            frame = W.partitionBy(*keys)
            line = frame.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
            return df.select(
                *kept,
                *[F.sum(f"_x_{n}").over(line).alias(n) for n in sums],
                *[F.sum(f"_x_{s}").over(frame).alias(t) for t, s in totals.items()],
            )
        df = _mark_hot(df, hot, keys)
    else:
        hot_total = None
        df = df.withColumn("_hot", F.lit(True))

    df, buckets = range_buckets(df, order, parts, F.col("_hot"), hot_total)
    group = [*keys, *buckets]
    pieces = (
        df.where("_hot")
        .groupBy(*group)
        .agg(*[F.sum(f"_x_{n}").alias(f"_p_{n}") for n in sums])
    )
    before = W.partitionBy(*keys) if keys else W.partitionBy()
    line = before.orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *group,
        *[F.coalesce(F.sum(f"_p_{n}").over(line), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_p_{s}").over(before).alias(f"_t_{t}") for t, s in totals.items()],
    )
    piece = W.partitionBy(*group)
    inner = piece.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.select(
        "*",
        *[F.sum(f"_x_{n}").over(inner).alias(f"_i_{n}") for n in sums],
        *[F.sum(f"_x_{s}").over(piece).alias(f"_c_{t}") for t, s in totals.items()],
    )
    joined = df.join(offsets, _null_safe(df, offsets, group), "left")
    return joined.select(
        *[df[c] for c in kept],
        *[(df[f"_i_{n}"] + F.coalesce(offsets[f"_o_{n}"], F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(offsets[f"_t_{t}"], df[f"_c_{t}"]).alias(t) for t in totals],
    )


def _mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_hot``; the join is split at run time, as ``hot`` is a stored table."""
    marks = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_is_hot"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & df[k].eqNullSafe(marks[f"_k{i}"])
    return df.join(marks, match, "left").select(df["*"], F.coalesce("_is_hot", F.lit(False)).alias("_hot"))


def join_per_key(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a table with one row per key to all rows of that key.

    AQE splits a skewed side only when both sides come straight from a shuffle, which an
    aggregate does not.  So rows of a hot key are dealt over as many tasks as there are
    shuffle partitions, by a hash of the ``spread`` columns, and only the hot keys' rows
    of ``stats`` are repeated to meet them.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, hot_rows)
    if hot.isEmpty():
        return df.join(stats, keys, how)
    salts = max(2, shuffle_partitions(df.sparkSession))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = _mark_hot(df, hot, keys).withColumn("_salt", salt).drop("_hot")
    right = _mark_hot(stats, hot, keys).withColumn("_salt", F.explode(places)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    match = F.lit(True)
    for name in names:
        match = match & left[name].eqNullSafe(right[name])
    return match


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "seq",
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of each row along ``order`` within ``keys``, and the key's size."""
    one = F.lit(1).cast("long")
    return running(df, keys, order, {name: one}, {total: name} if total else None, hot_rows)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    width: int,
    columns: Mapping[str, Column],
    chunk: int = 100_000,
) -> DataFrame:
    """Aggregates over the last ``width`` rows by a dense 1-based ``position``.

    Keys are cut into chunks of ``chunk`` positions; the last ``width - 1`` rows of a
    chunk are handed to the next one too, so no task holds a whole key.  ``columns``
    maps an output name to an aggregate such as ``F.sum("x")``.
    """
    if width > chunk:
        raise ValueError("chunk must be at least as long as the frame")
    kept = df.columns
    home = F.floor((F.col(position) - 1) / chunk).cast("long")
    in_tail = F.pmod(F.col(position) - 1, F.lit(chunk)) >= chunk - (width - 1)
    homes = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    frame = (
        W.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(-(width - 1), W.currentRow)
    )
    return (
        df.select("*", F.explode(homes).alias("_chunk"))
        .select("*", *[e.over(frame).alias(n) for n, e in columns.items()])
        .where(F.col("_chunk") == home)
        .select(*kept, *columns)
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles per key; ``probs`` maps output names to p.

    Equal values are counted first, then the counts are summed along the value, and
    each quantile is read off at its rank.  One row per key, nulls ignored.  The counts
    are written out once, since finding the ranges and summing both read them.
    """
    keys = list(keys)
    counted = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(counted, keys, [value], {"_upto": F.col("_n")}, {"_all": "_upto"}, hot_rows)
    picks = []
    for name, p in probs.items():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_upto") > F.floor(rank), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(rank), F.col(value))).alias(f"_hi_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    out = []
    for name, p in probs.items():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return picked.select(*keys, *out)


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table added, as a scalar subquery."""
    return df.withColumn("_one", one.select(F.struct(*one.columns)).scalar()).select(
        *df.columns, "_one.*"
    )
