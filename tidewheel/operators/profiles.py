"""User vectors: preference profiles of rating histories, watch-time profiles of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewheel.functions import vectors


def _preference(boot: DataFrame, anchor: float) -> DataFrame:
    gain = F.greatest(F.col("rating") - F.lit(float(anchor)), F.lit(0.0))
    return boot.withColumn("weight", gain * F.col("time_weight"))


def _preferred(boot: DataFrame, anchor: float) -> DataFrame:
    """Events with a weight; the first filter is one that Spark can put before the joins of ``boot``."""
    return _preference(boot.where(F.col("rating") > F.lit(float(anchor))), anchor).where(F.col("weight") > 0)


def preference_profile(
    boot: DataFrame,
    items: DataFrame,
    name: str = "long_term_embedding",
    anchor: float = 3.5,
    min_weight: float = 1e-8,
) -> DataFrame:
    """Σ w·v / Σ w over bootstrap events, w = max(rating - anchor, 0) · time_weight.

    Weights of one user and item are added up before the vectors are joined, so each
    vector travels once per user and item, and not once per event.
    """
    weights = _preferred(boot, anchor).groupBy("user_id", "movie_id").agg(F.sum("weight").alias("weight"))
    joined = weights.join(items, "movie_id")
    return vectors.weighted_mean(joined, ["user_id"], "movie_embedding", "weight", name, min_weight)


def preference_profiles(
    boot: DataFrame, items: DataFrame, recent_k: int = 10, anchor: float = 3.5, min_weight: float = 1e-8
) -> DataFrame:
    """``preference_profile`` of all and of the last ``recent_k`` bootstrap events in one pass:
    user_id, long_term_embedding, short_term_embedding, where a user without one has NULL.

    Vectors go to their users as they are, once per user and item for both: joined by item, a
    user's rows lie in as many tasks as there are rows, and partial sums are several times as large
    as a vector.  So a user's task reads at most one vector per item.
    """
    kinds = ("long_term_embedding", "short_term_embedding")
    weights = _preferred(boot, anchor).groupBy("user_id", "movie_id").agg(
        F.sum("weight").alias(kinds[0]), F.sum(F.when(_recent(recent_k), F.col("weight"))).alias(kinds[1])
    )
    known = items.where(F.col("movie_embedding").isNotNull())
    placed = weights.join(known, "movie_id").repartition("user_id")
    sides = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("weight")) for i, k in enumerate(kinds)])
    each = placed.select("user_id", "movie_embedding", F.explode(sides).alias("_s")).select("user_id", "movie_embedding", "_s.*")
    means = vectors.weighted_mean(each, ["user_id", "kind"], "movie_embedding", "weight", "embedding", min_weight)
    return means.groupBy("user_id").agg(
        *[F.first(F.when(F.col("kind") == i, F.col("embedding")), ignorenulls=True).alias(k) for i, k in enumerate(kinds)]
    )


def _recent(k: int) -> Column:
    return F.col("event_order") > F.col("boot_n") - k


def recent_bootstrap(boot: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` bootstrap events of each user."""
    return boot.where(_recent(k))


def embedded_counts(boot: DataFrame, items: DataFrame, anchor: float = 3.5) -> DataFrame:
    """Per user: events used in the vector, events whose item has no vector.

    Events meet the items' ids one by one: tables of (user, item) pairs, almost as many as
    there are events, would have to stand in memory before and after a shuffle.
    """
    known = items.select("movie_id", F.lit(True).alias("_known"))
    return (
        _preference(boot, anchor)
        .select("user_id", "movie_id", "weight")
        .join(known, "movie_id", "left")
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("_known") & (F.col("weight") > 0))
            .cast("int")
            .alias("num_embedded_bootstrap_interactions"),
            F.count_if(F.col("_known").isNull())
            .cast("int")
            .alias("num_missing_embedding_movies"),
        )
    )


def base_user_profiles(
    boot: DataFrame,
    items: DataFrame,
    version: str = "v1",
    recent_k: int = 10,
    anchor: float = 3.5,
    min_weight: float = 1e-8,
) -> DataFrame:
    """Long- and short-term vectors with counts, one row per user of ``boot``."""
    both = preference_profiles(boot, items, recent_k, anchor, min_weight)
    level = boot.groupBy("user_id").agg(
        F.avg("rating").alias("rating_bias"),
        F.count(F.lit(1)).cast("double").alias("activity_level"),
    )
    counts = embedded_counts(boot, items, anchor)
    return (
        level.join(counts, "user_id", "left")
        .join(both, "user_id", "left")
        .select(
            "user_id",
            "long_term_embedding",
            "short_term_embedding",
            F.greatest(F.size("long_term_embedding"), F.size("short_term_embedding")).alias("embedding_dim"),
            "num_embedded_bootstrap_interactions",
            "num_missing_embedding_movies",
            "rating_bias",
            "activity_level",
            F.lit(version).alias("profile_version"),
        )
    )


def fused_users(
    profiles: DataFrame, long_weight: float = 0.4, short_weight: float = 0.6
) -> DataFrame:
    """One vector per user; users without any, or with differing lengths, are left out."""
    mixed = vectors.fuse("long_term_embedding", "short_term_embedding", long_weight, short_weight)
    return profiles.select("user_id", mixed.alias("user_embedding"), "profile_version").where(
        F.col("user_embedding").isNotNull()
    )


def fuse_counts(profiles: DataFrame) -> DataFrame:
    """How many users were fused, kept from one side, mismatched, or had nothing."""
    a, b = F.col("long_term_embedding"), F.col("short_term_embedding")
    both = a.isNotNull() & b.isNotNull()
    case = (
        F.when(both & (F.size(a) == F.size(b)), "fused")
        .when(both, "length_mismatch")
        .when(a.isNotNull(), "long_only")
        .when(b.isNotNull(), "short_only")
        .otherwise("none")
    )
    return profiles.groupBy(case.alias("source")).agg(F.count(F.lit(1)).alias("users"))


def recent_events(
    events: DataFrame,
    limit: int = 200,
    as_of=None,
    hours: int | None = 720,
    users: DataFrame | None = None,
) -> DataFrame:
    """The latest ``limit`` events of each user, optionally not older than ``hours``.

    The rank filter is applied in each map task too, so a hot user ships at most
    ``limit`` rows per task.
    """
    if hours is not None:
        if as_of is None:
            raise ValueError("as_of is needed to look back a number of hours")
        events = events.where(
            F.col("event_time") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
        )
    if users is not None:
        events = events.join(users, "user_id", "left_semi")
    line = W.partitionBy("user_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    return (
        events.withColumn("recency", F.row_number().over(line)).where(F.col("recency") <= limit)
    )


def watch_profile(
    events: DataFrame,
    items: DataFrame,
    as_of,
    users: DataFrame | None = None,
    limit: int = 200,
    hours: int = 720,
    min_watch: float = 30.0,
) -> DataFrame:
    """Watch-time weighted vector of each user's recent events, with its source counts.

    Users none of whose recent items has a vector get no row.
    """
    recent = recent_events(events, limit, as_of, hours, users)
    weight = F.greatest(F.col("watch_duration_seconds"), F.lit(float(min_watch)))
    recent = recent.select("user_id", "movie_id", "event_id", weight.alias("weight"))
    source = recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("source_event_count"),
        F.max("event_id").alias("source_event_max_id"),
    )
    joined = recent.join(items, "movie_id")
    means = vectors.weighted_mean(joined, ["user_id"], "movie_embedding", "weight")
    return means.join(source, "user_id")


def previous_versions(snapshots: DataFrame, order: str = "updated_at") -> DataFrame:
    """The latest embedding version of each user."""
    return snapshots.groupBy("user_id").agg(
        F.max_by("embedding_version", order).alias("previous_version")
    )


def refresh_summary(updates: DataFrame) -> DataFrame:
    """Greatest previous version and greatest event id over the updated users."""
    return updates.agg(
        F.max("previous_version").alias("previous_version"),
        F.max("source_event_max_id").alias("source_event_max_id"),
        F.count(F.lit(1)).alias("user_count"),
    )
