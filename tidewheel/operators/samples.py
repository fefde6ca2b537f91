"""Training samples: offline joins, and the online as-of join with its coverage cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel.operators.cleaning import require_columns
from tidewheel.operators.ordering import join_per_key
from tidewheel.session import cut_lineage


def offline_samples(remaining: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Remaining events with the user's fused vector and the item's vector, label = rating.

    Both sides hold one row per key.  No broadcast is forced: Spark broadcasts a side
    only below its size threshold, else it sort-merges and splits skewed partitions.
    """
    require_columns(remaining, ["user_id", "movie_id", "rating", "timestamp"], "remaining events")
    return attach_vectors(remaining, users, items).select(
        "user_id",
        "movie_id",
        "timestamp",
        "event_time",
        "future_event_order",
        F.col("rating").cast("double").alias("label"),
        "user_embedding",
        "movie_embedding",
        "profile_version",
    )


def attach_vectors(rows: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose user and item both have a vector, with the vectors."""
    require_columns(users, ["user_id", "user_embedding"], "users")
    require_columns(items, ["movie_id", "movie_embedding"], "items")
    return rows.join(items, "movie_id").join(users, "user_id")


def matched(rows: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """The rows ``attach_vectors`` would keep, without the vectors: only ids are shuffled."""
    return rows.join(items.select("movie_id"), "movie_id", "left_semi").join(
        users.select("user_id"), "user_id", "left_semi"
    )


def file_user_counts(events: DataFrame) -> DataFrame:
    """Rows of each user in each input file."""
    return events.groupBy("file_id", "input_time", "user_id").agg(F.count(F.lit(1)).alias("user_rows"))


def as_of_picks(events: DataFrame, versions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each input file and user, the embedding version to use.

    ``events`` carries file_id, input_time and user_id, ``versions`` user_id and
    version_time.  Per file, versions not later than the file are consulted newest
    first; a user takes the newest that has them; consulting stops once the share of
    matched rows reaches ``threshold``.  Users found only in versions that were not
    consulted get no pick.

    The newest version per (file, user) is found by carrying versions forward along
    each user's time line, so no file-version pairs are formed.  The narrow counts and the
    newest versions are written once, as several steps read them.
    """
    counts = cut_lineage(file_user_counts(events))
    known = versions.where(F.col("version_time").isNotNull()).select("user_id", "version_time").distinct()
    line = (
        W.partitionBy("user_id")
        .orderBy("_time", "_side")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    points = counts.select(
        "user_id", F.col("input_time").alias("_time"), F.lit(1).alias("_side"),
        F.lit(None).cast(known.schema["version_time"].dataType).alias("_version"),
        "file_id", "user_rows",
    ).unionByName(
        known.select(
            "user_id", F.col("version_time").alias("_time"), F.lit(0).alias("_side"),
            F.col("version_time").alias("_version"),
            F.lit(None).cast(counts.schema["file_id"].dataType).alias("file_id"),
            F.lit(None).cast("long").alias("user_rows"),
        )
    )
    newest = cut_lineage(
        points.withColumn("version_time", F.last("_version", ignorenulls=True).over(line))
        .where((F.col("_side") == 1) & F.col("version_time").isNotNull())
        .select("file_id", F.col("_time").alias("input_time"), "user_id", "user_rows", "version_time")
    )
    totals = counts.groupBy("file_id").agg(F.sum("user_rows").alias("file_rows"))
    per_version = newest.groupBy("file_id", "input_time", "version_time").agg(
        F.sum("user_rows").alias("_matched")
    )
    if threshold <= 0:
        # the very first version consulted always reaches the threshold
        latest = _newest_eligible(counts.select("file_id", "input_time").distinct(), known)
        open_versions = per_version.join(latest, ["file_id", "version_time"], "left_semi")
    else:
        earlier = (
            W.partitionBy("file_id")
            .orderBy(F.desc("version_time"))
            .rowsBetween(W.unboundedPreceding, -1)
        )
        before = F.coalesce(F.sum("_matched").over(earlier), F.lit(0))
        open_versions = (
            per_version.join(totals, "file_id")
            .withColumn("_before", before)
            .where(F.col("_before") / F.greatest(F.col("file_rows"), F.lit(1)) < F.lit(float(threshold)))
        )
    # stored, so that the join of a large file's rows is split at run time
    chosen = cut_lineage(open_versions.select("file_id", "version_time"))
    return newest.join(chosen, ["file_id", "version_time"], "left_semi")


def _newest_eligible(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Per file, the newest version of any user that is not later than the file."""
    # version names are a directory listing: one short array, not data-sized
    times = versions.agg(F.collect_set("version_time")).scalar()
    return files.withColumn("_times", times).select(
        "file_id",
        F.array_max(F.filter("_times", lambda t: t <= F.col("input_time"))).alias("version_time"),
    )


def online_matched(
    events: DataFrame, versions: DataFrame, items: DataFrame, threshold: float = 0.8
) -> DataFrame:
    """Events that get both vectors, with the version to use, before the vectors are joined."""
    require_columns(events, ["user_id", "movie_id", "watch_duration_seconds"], "events")
    picks = as_of_picks(events, versions, threshold).select("file_id", "user_id", "version_time")
    known = events.join(items.select("movie_id"), "movie_id", "left_semi")
    return (
        join_per_key(known, picks, ["file_id", "user_id"], ["event_id"])
        .select(
            "file_id",
            "event_id",
            "user_id",
            "movie_id",
            "version_time",
            F.col("watch_duration_seconds").cast("double").alias("label"),
        )
    )


def attach_online_vectors(rows: DataFrame, versions: DataFrame, items: DataFrame) -> DataFrame:
    vectors = versions.select("user_id", "version_time", "user_embedding")
    return rows.join(items, "movie_id").join(vectors, ["user_id", "version_time"])


def online_samples(
    events: DataFrame, versions: DataFrame, items: DataFrame, threshold: float = 0.8
) -> DataFrame:
    """Events with the as-of user vector and the item vector, label = raw watch seconds."""
    return attach_online_vectors(online_matched(events, versions, items, threshold), versions, items)


def coverage_report(events: DataFrame, versions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per input file: rows, rows of matched users, their share, versions picked from."""
    files = events.groupBy("file_id").agg(F.count(F.lit(1)).alias("file_rows"))
    matched = (
        as_of_picks(events, versions, threshold)
        .groupBy("file_id")
        .agg(
            F.sum("user_rows").alias("matched_rows"),
            F.count_distinct("version_time").alias("versions_used"),
        )
    )
    rows = F.coalesce("matched_rows", F.lit(0))
    return files.join(matched, "file_id", "left").select(
        "file_id",
        "file_rows",
        rows.alias("matched_rows"),
        (rows / F.greatest("file_rows", F.lit(1))).alias("coverage"),
        F.coalesce("versions_used", F.lit(0)).alias("versions_used"),
    )


def newer_versions(versions: DataFrame, done, time: str = "version_time") -> DataFrame:
    """Input versions later than the last one processed; all of them when there is none."""
    return versions if done is None else versions.where(F.col(time) > F.lit(done))


def build_status(input_versions: int, new_versions: int) -> str:
    if input_versions == 0:
        return "no_input_versions"
    return "ok" if new_versions else "already_up_to_date"
