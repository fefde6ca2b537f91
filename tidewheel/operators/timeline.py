"""Per-user histories: order, duplicates, the bootstrap cut, decay and centring."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import DataFrame, functions as F

from tidewheel.operators.ordering import HOT_ROWS, join_per_key, number_rows

ORDER = ("timestamp", "source_key", "movie_id", "rating")


def user_timeline(ratings: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events numbered from 1 in time order within each user, ``n`` being the user's total.

    Rows of a distributed table have no order of their own, so ties in time are settled
    by the further ``order`` columns.
    """
    return number_rows(ratings, ["user_id"], order, "event_order", "n", hot_rows)


def dedup_keep_last(
    ratings: DataFrame,
    keys: Sequence[str] = ("user_id", "movie_id"),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The latest row of each user and item, merged map-side before the shuffle."""
    rest = [c for c in ratings.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return ratings.groupBy(*keys).agg(latest).select(*keys, "_last.*").select(*ratings.columns)


def bootstrap_cut(
    ratings: DataFrame,
    ratio: float = 0.7,
    min_events: int = 5,
    min_bootstrap: int = 3,
    min_remaining: int = 1,
    order: Sequence[str] = ORDER,
    keep_last: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each user's events split into the first ``b`` (bootstrap) and the rest (remaining).

    b = min(max(min_bootstrap, floor(ratio n)), n - min_remaining); users that are too
    short for it are left out.  Adds event_order, n, boot_n, part, future_event_order.
    """
    events = dedup_keep_last(ratings, order=order) if keep_last else ratings
    events = user_timeline(events, order, hot_rows)
    wanted = F.greatest(F.lit(min_bootstrap).cast("long"), F.floor(F.col("n") * F.lit(float(ratio))))
    events = events.withColumn("boot_n", F.least(wanted, F.col("n") - min_remaining))
    fits = (
        (F.col("n") >= min_events)
        & (F.col("boot_n") >= min_bootstrap)
        & (F.col("n") - F.col("boot_n") >= min_remaining)
    )
    early = F.col("event_order") <= F.col("boot_n")
    return (
        events.where(fits)
        .withColumn("part", F.when(early, "bootstrap").otherwise("remaining"))
        .withColumn("future_event_order", F.when(~early, F.col("event_order") - F.col("boot_n")))
    )


def base_events(
    cut: DataFrame, half_life_days: float = 180.0, positive_from: float = 4.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Bootstrap rows with event time, positive flag, centred rating and time weight."""
    boot = cut.where(F.col("part") == "bootstrap")
    per_user = boot.groupBy("user_id").agg(
        F.max("timestamp").alias("_last_ts"), F.avg("rating").alias("_mean")
    )
    decay = math.log(2.0) / max(half_life_days, 1)
    age_days = (F.col("_last_ts") - F.col("timestamp")).cast("double") / F.lit(86400.0)
    return join_per_key(boot, per_user, ["user_id"], ["event_order"], hot_rows=hot_rows).select(
        "user_id",
        "movie_id",
        "rating",
        "timestamp",
        F.timestamp_seconds("timestamp").alias("event_time"),
        F.col("event_order").cast("int").alias("event_order"),
        (F.col("rating") >= positive_from).alias("is_positive"),
        (F.col("rating") - F.col("_mean")).alias("rating_centered"),
        F.exp(F.lit(-decay) * age_days).alias("time_weight"),
        "boot_n",
    )


def remaining_events(cut: DataFrame) -> DataFrame:
    return cut.where(F.col("part") == "remaining").select(
        "user_id",
        "movie_id",
        "rating",
        "timestamp",
        F.timestamp_seconds("timestamp").alias("event_time"),
        F.col("future_event_order").cast("int").alias("future_event_order"),
    )


def user_stats(cut: DataFrame) -> DataFrame:
    """Totals, time span, mean, spread and activity of each user's bootstrap events."""
    boot = F.col("part") == "bootstrap"
    rating = F.when(boot, F.col("rating"))
    ts = F.when(boot, F.col("timestamp"))
    grouped = cut.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_total_interactions"),
        F.count_if(boot).cast("int").alias("num_bootstrap_interactions"),
        F.count_if(~boot).cast("int").alias("num_remaining_interactions"),
        F.min("timestamp").alias("first_timestamp"),
        F.max(ts).alias("last_bootstrap_timestamp"),
        F.max("timestamp").alias("last_total_timestamp"),
        F.avg(rating).alias("avg_rating_bootstrap"),
        F.coalesce(F.stddev_samp(rating), F.lit(0.0)).alias("std_rating_bootstrap"),
    )
    span = (F.col("last_total_timestamp") - F.col("first_timestamp")).cast("double") / F.lit(86400.0)
    return grouped.select(
        "*",
        span.alias("activity_span_days"),
        F.log1p(F.col("num_bootstrap_interactions").cast("double")).alias("profile_confidence"),
    )


def build_counters(ratings: DataFrame, cut: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of totals for the manifest of a profile build."""
    seen = ratings.agg(F.count_distinct("user_id").alias("users_seen"))
    kept = cut.agg(
        F.count_distinct("user_id").alias("users_kept"),
        F.count_if(F.col("part") == "bootstrap").alias("bootstrap_events"),
        F.count_if(F.col("part") == "remaining").alias("remaining_events"),
    )
    vec = profiles.agg(
        F.count("long_term_embedding").alias("users_with_long_vector"),
        F.count("short_term_embedding").alias("users_with_short_vector"),
    )
    one = lambda df, name: df.select(name).scalar().alias(name)
    return seen.select(
        "users_seen",
        one(kept, "users_kept"),
        (F.col("users_seen") - kept.select("users_kept").scalar()).alias("users_skipped"),
        one(kept, "bootstrap_events"),
        one(kept, "remaining_events"),
        one(vec, "users_with_long_vector"),
        one(vec, "users_with_short_vector"),
    )
