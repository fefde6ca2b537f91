"""Vector expressions on ARRAY columns; sums are taken in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a, b) -> Column:
    squares = F.zip_with(
        _col(a), _col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a, b, zero: str = "null") -> Column:
    """Cosine under one of four rules for vanishing norms.

    ``null``   NULL when the product of the norms is 0 (profiling)
    ``model``  1e-8 added to the product (pair features)
    ``zero``   0.0 when lengths differ or a norm is at most 1e-12
    ``search`` 1e-12 added to each norm (retrieval)
    """
    product, na, nb = dot(a, b), norm(a), norm(b)
    if zero == "null":
        return F.try_divide(product, na * nb)
    if zero == "model":
        return product / (na * nb + F.lit(1e-8))
    if zero == "zero":
        bad = (F.size(_col(a)) != F.size(_col(b))) | (na <= 1e-12) | (nb <= 1e-12)
        return F.when(bad, F.lit(0.0)).otherwise(product / (na * nb))
    if zero == "search":
        return product / ((na + F.lit(1e-12)) * (nb + F.lit(1e-12)))
    raise ValueError(f"unknown zero rule: {zero}")


def cosine_block(a, b) -> Column:
    """Cosine of two list columns under the rule ``null``, by blocks of rows.

    The lists of an Arrow batch are one buffer each; products and squares are summed per row
    over whole buffers.  NULL where a list or one of its items is NULL, where the lengths
    differ, or where a norm is 0.
    """
    return _cosines(_col(a), _col(b))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All items in DOUBLE, the length of each list, and whether list and items are not null."""
    bounds = np.asarray(column.offsets)
    items = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    lengths = np.diff(bounds)
    good = np.asarray(column.is_valid())
    if items.null_count:
        missing = np.concatenate([[0], np.cumsum(np.asarray(items.is_null()))])
        ends = np.cumsum(lengths)
        good = good & (missing[ends] == missing[ends - lengths])
    return np.asarray(items.cast(pa.float64()).fill_null(0.0)), lengths, good


@F.arrow_udf(T.DoubleType())
def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    (x, m, fine), (y, n, same) = _flat(a), _flat(b)
    used = fine & same & (m == n) & (m > 0)
    x, y, lengths = x[np.repeat(used, m)], y[np.repeat(used, n)], m[used]
    out = np.zeros(len(used))
    if len(lengths):
        starts = np.cumsum(lengths) - lengths
        dots, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
        size = np.sqrt(xx) * np.sqrt(yy)
        used[used] = size != 0
        out[used] = dots[size != 0] / size[size != 0]
    return pa.array(out, mask=~used)


def unit(v, floor: float = 1e-12) -> Column:
    """Vector divided by its length, the length being at least ``floor``."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(_col(v), lambda x: x.cast("double") / length)


def distance_to_score(d) -> Column:
    """Score of a squared distance between unit vectors."""
    return F.lit(1.0) - _col(d) / F.lit(2.0)


def pair_features(user, item) -> Column:
    """user ‖ item ‖ cosine ‖ dot ‖ distance, 2d + 3 doubles."""
    tail = F.array(cosine(user, item, "model"), dot(user, item), l2_distance(user, item))
    return F.concat(doubles(user), doubles(item), tail)


def fuse(long_v, short_v, long_weight: float = 0.4, short_weight: float = 0.6) -> Column:
    """Weighted sum of two vectors; one alone is kept, differing lengths give NULL."""
    if long_weight < 0 or short_weight < 0 or long_weight + short_weight == 0:
        raise ValueError("fuse weights must not be negative and not both zero")
    a, b = _col(long_v), _col(short_v)
    mixed = F.zip_with(
        a, b, lambda x, y: x.cast("double") * long_weight + y.cast("double") * short_weight
    ).cast("array<float>")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both & (F.size(a) == F.size(b)), mixed).when(
        ~both, F.coalesce(b, a).cast("array<float>")
    )


def choose(long_v, short_v) -> Column:
    """The long vector if it has elements, else the short one, else NULL."""
    a, b = _col(long_v), _col(short_v)
    return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b)


def chosen_source(long_v, short_v) -> Column:
    a, b = _col(long_v), _col(short_v)
    return (
        F.when(F.size(a) > 0, F.lit("long_term"))
        .when(F.size(b) > 0, F.lit("short_term"))
        .otherwise(F.lit("none"))
    )


def parse_vector(df: DataFrame, name: str) -> Column:
    """Vector from a list or from JSON text; NULL unless every element is a number."""
    kind = dict(df.dtypes)[name]
    v = F.from_json(name, "array<double>") if kind == "string" else F.col(name).cast("array<double>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v)


def vector_text(v) -> Column:
    return F.to_json(_col(v))


def weighted_mean(
    df: DataFrame,
    keys: Sequence[str],
    vector: str,
    weight: str,
    name: str = "embedding",
    min_weight: float = 0.0,
) -> DataFrame:
    """Σ w·v / Σ w per key as ARRAY<FLOAT>, for keys with Σ w above ``min_weight``.

    Rows without a vector or with weight 0 do not count.  Partial sums are formed per
    task before the shuffle, so a hot key sends one vector per map task.  The last bits
    of a sum depend on how rows are spread; rounding them off makes the FLOAT repeatable.
    """
    used = df.where(F.col(vector).isNotNull() & (F.col(weight) > 0)).select(
        *keys,
        array_to_vector(doubles(vector)).alias("_v"),
        F.col(weight).cast("double").alias("_w"),
    )
    grouped = used.groupBy(*keys).agg(
        Summarizer.mean(F.col("_v"), F.col("_w")).alias("_mean"), F.sum("_w").alias("_sum")
    )
    steady = F.transform(vector_to_array("_mean"), lambda x: F.round(x, 12))
    return grouped.where(F.col("_sum") > min_weight).select(
        *keys, steady.cast("array<float>").alias(name)
    )
