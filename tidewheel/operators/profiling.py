"""Dataset profile: overview, activity, labels, vectors, similarity and time range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewheel.functions import vectors
from tidewheel.operators.ordering import exact_quantiles, with_one_row
from tidewheel.session import cut_lineage

QUANTILES = {"p01": 0.01, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p99": 0.99}


def overview(df: DataFrame, time: str = "timestamp", exact: bool = False) -> DataFrame:
    """Rows, time range, distinct users and items (approximate unless ``exact``)."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(time).alias("min_timestamp"),
        F.max(time).alias("max_timestamp"),
        distinct("user_id").alias("distinct_users"),
        distinct("movie_id").alias("distinct_movies"),
    )


def activity(df: DataFrame, key: str) -> DataFrame:
    """Spread of the number of rows per ``key``.

    Counts are counted before they are sorted: there are at most sqrt(2 rows) different
    ones, so the final quantile state stays small.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    shape = per_key.groupBy("c").agg(F.count(F.lit(1)).alias("f"))
    mean = F.sum(F.col("c") * F.col("f")) / F.sum("f")
    quantile = lambda p: F.percentile("c", F.lit(p), F.col("f"))
    moments = per_key.agg(F.stddev_samp("c").alias("s"))
    return shape.agg(
        F.sum("f").alias("entities"),
        F.min("c").alias("min_events"),
        F.max("c").alias("max_events"),
        mean.alias("avg_events"),
        quantile(0.50).alias("p50_events"),
        quantile(0.90).alias("p90_events"),
        quantile(0.99).alias("p99_events"),
    ).withColumn("std_events", F.coalesce(moments.scalar(), F.lit(0.0)))


def label_stats(df: DataFrame, label: str = "label") -> DataFrame:
    df = cut_lineage(df.select(label))
    base = df.agg(
        F.count(label).alias("rows"),
        F.min(label).alias("min_label"),
        F.max(label).alias("max_label"),
        F.avg(label).alias("avg_label"),
        F.stddev_samp(label).alias("std_label"),
    )
    return with_one_row(base, exact_quantiles(df, label, QUANTILES))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label_value")).agg(F.count(F.lit(1)).alias("sample_count"))


def vector_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least, middle and greatest length of each vector column."""
    stats = []
    for c in columns:
        stats += [
            F.min(F.size(c)).alias(f"min_{c}_len"),
            # few different lengths exist, so the exact quantile's state is tiny
            F.percentile(F.size(c), F.lit(0.5)).alias(f"p50_{c}_len"),
            F.max(F.size(c)).alias(f"max_{c}_len"),
        ]
    return df.agg(*stats)


def _sample(df: DataFrame, fraction: float | None, seed: int) -> DataFrame:
    return df if fraction is None else df.sample(fraction, seed)


def _similarity(df: DataFrame, user: str, item: str) -> DataFrame:
    return df.withColumn("cosine_sim", vectors.cosine_block(user, item)).where(
        F.col("cosine_sim").isNotNull()
    )


def similarity_histogram(
    df: DataFrame,
    user: str = "user_embedding",
    item: str = "movie_embedding",
    label: str = "label",
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Per 0.05-wide cosine bin: rows, label range and mean, mean cosine."""
    seen = _similarity(_sample(df, fraction, seed), user, item)
    return seen.groupBy((F.floor(F.col("cosine_sim") * 20) / 20).alias("sim_bin")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(label).alias("avg_label"),
        F.min(label).alias("min_label"),
        F.max(label).alias("max_label"),
        F.avg("cosine_sim").alias("avg_cosine_sim"),
    )


def cosine_stats(
    df: DataFrame,
    user: str = "user_embedding",
    item: str = "movie_embedding",
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    seen = cut_lineage(_similarity(_sample(df, fraction, seed), user, item).select("cosine_sim"))
    base = seen.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("cosine_sim").alias("min_cosine"),
        F.max("cosine_sim").alias("max_cosine"),
        F.avg("cosine_sim").alias("avg_cosine"),
        F.stddev_samp("cosine_sim").alias("std_cosine"),
    )
    return with_one_row(base, exact_quantiles(seen, "cosine_sim", QUANTILES))


def time_extremes(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` earliest and the ``n`` latest rows by ``order``."""
    first = df.orderBy(*order).limit(n).withColumn("side", F.lit("earliest"))
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("side", F.lit("latest"))
    return first.unionAll(last)


def profile(df: DataFrame, blocks: Mapping[str, bool] | None = None) -> dict[str, DataFrame]:
    """All profile blocks by name; ``blocks`` switches single ones off."""
    vecs = {"user_embedding", "movie_embedding"} <= set(df.columns)
    made = {
        "overview": lambda: overview(df),
        "user_activity": lambda: activity(df, "user_id"),
        "movie_activity": lambda: activity(df, "movie_id"),
        "label_stats": lambda: label_stats(df),
        "label_histogram": lambda: label_histogram(df),
        "time_extremes": lambda: time_extremes(
            df.select("timestamp", "user_id", "movie_id"), ["timestamp", "user_id", "movie_id"]
        ),
    }
    if vecs:
        made["vector_shape"] = lambda: vector_shape(df, ["user_embedding", "movie_embedding"])
        made["similarity_histogram"] = lambda: similarity_histogram(df)
        made["cosine_stats"] = lambda: cosine_stats(df)
    wanted = blocks or {}
    return {name: make() for name, make in made.items() if wanted.get(name, True)}
