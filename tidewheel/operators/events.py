"""Watch and login events: windows, sessions, user state, popularity, intake checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewheel.operators.ordering import HOT_ROWS, join_per_key


def finished(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "finish")


def window_start(time: str, minutes: int) -> Column:
    """Start of the window: minutes of the hour floored to a multiple of ``minutes``.

    Windows restart every hour; with a length that does not divide 60 they may overlap
    the next hour's first one.
    """
    hour = F.date_trunc("hour", F.col(time))
    offset = F.floor(F.minute(time) / minutes) * minutes
    return hour + F.make_dt_interval(F.lit(0), F.lit(0), offset.cast("int"))


def window_stats(
    events: DataFrame, minutes: int = 5, short_seconds: float = 10.0, time: str = "event_time"
) -> DataFrame:
    """Events and short watches per window."""
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return (
        events.groupBy(window_start(time, minutes).alias("window_start"))
        .agg(*window_counters(short_seconds))
        .withColumn("window_end", F.col("window_start") + length)
    )


def window_counters(short_seconds: float = 10.0) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("watch_duration_seconds") < short_seconds).alias("abnormal_count"),
    ]


def with_session(auth: DataFrame) -> DataFrame:
    """Fill a missing session id with ``fallback-<user>-<event>``."""
    stand_in = F.concat_ws("-", F.lit("fallback"), "user_id", "event_id")
    return auth.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), stand_in))


def activity(auth: DataFrame, user_events: DataFrame) -> DataFrame:
    """Login, logout and finish events in one narrow stream."""
    return (
        with_session(auth)
        .select("event_id", "user_id", "session_id", "event_type", "event_time",
                F.lit(0.0).alias("watch_duration_seconds"))
        .unionByName(
            finished(user_events).select(
                "event_id", "user_id", "session_id", "event_type", "event_time", "watch_duration_seconds"
            )
        )
    )


def _moment() -> Column:
    return F.struct("event_time", "event_id")


def session_aggregates() -> list[Column]:
    """Order-free aggregates from which a session's state follows."""
    kind = F.col("event_type")
    finish, login, logout = kind == "finish", kind == "login", kind == "logout"
    opener = login | finish
    return [
        F.min(F.when(opener, _moment())).alias("created"),
        F.max(F.when(login, _moment())).alias("last_login"),
        F.max(F.when(logout, _moment())).alias("last_logout"),
        F.max(F.when(login, F.struct("event_time", "event_id", "user_id"))).alias("login_user"),
        F.min(F.when(opener, F.struct("event_time", "event_id", "user_id"))).alias("first_user"),
        F.count_if(finish).alias("event_count"),
        F.sum(F.when(finish, F.col("watch_duration_seconds")).otherwise(0.0)).alias(
            "total_watch_duration_seconds"
        ),
        F.max(F.when(finish, F.struct("event_id", "event_time"))).alias("last_finish"),
    ]


def session_state(grouped: DataFrame) -> DataFrame:
    """Sessions from ``session_aggregates``; a session known only by logouts has no row.

    A login opens or re-opens it, a logout later than that closes it, a finish event
    never changes its status.
    """
    closed = (F.col("last_logout") > F.col("created")) & F.coalesce(
        F.col("last_logout") > F.col("last_login"), F.lit(True)
    )
    closed = F.coalesce(closed, F.lit(False))
    return grouped.where(F.col("created").isNotNull()).select(
        "session_id",
        F.coalesce(F.col("login_user.user_id"), F.col("first_user.user_id")).alias("user_id"),
        F.col("created.event_time").alias("session_start_time"),
        F.when(closed, F.col("last_logout.event_time")).alias("session_end_time"),
        F.col("last_finish.event_time").alias("last_event_time"),
        F.when(closed, F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        "event_count",
        "total_watch_duration_seconds",
    )


def session_stats(auth: DataFrame, user_events: DataFrame) -> DataFrame:
    grouped = activity(auth, user_events).groupBy("session_id").agg(*session_aggregates())
    return session_state(grouped)


def user_aggregates() -> list[Column]:
    login = F.col("event_type") == "login"
    return [
        F.count_if(login).alias("login_count"),
        F.max(F.when(login, F.struct("event_id", "event_time"))).alias("last_login"),
        F.max(F.struct("event_id", "event_time")).alias("last_any"),
        F.min("event_time").alias("first_seen_at"),
        F.max("event_time").alias("newest_event_time"),
    ]


def user_state(grouped: DataFrame) -> DataFrame:
    """Per user: logins, last login and last seen by event id, and the true time range."""
    return grouped.select(
        "user_id",
        "login_count",
        F.col("last_login.event_time").alias("last_login_at"),
        F.col("last_any.event_time").alias("last_seen_at"),
        "first_seen_at",
        "newest_event_time",
    )


def user_activity(auth: DataFrame, user_events: DataFrame) -> DataFrame:
    grouped = activity(auth, user_events).groupBy("user_id").agg(*user_aggregates())
    return user_state(grouped)


def popular_items(events: DataFrame, limit: int = 50) -> DataFrame:
    """Items by total watch time, then count, then id; rank from 1."""
    totals = events.groupBy("movie_id").agg(
        F.sum("watch_duration_seconds").alias("score"),
        F.count(F.lit(1)).alias("watch_count"),
    )
    return rank_items(totals, limit)


def rank_items(totals: DataFrame, limit: int = 50) -> DataFrame:
    order = [F.desc("score"), F.desc("watch_count"), F.asc("movie_id")]
    top = totals.orderBy(*order).limit(limit)
    # at most ``limit`` rows are left, so ranking them in one task is free
    return top.withColumn("rank_position", F.row_number().over(W.orderBy(*order)))


def popular_list(popular: DataFrame, limit: int = 20) -> DataFrame:
    return popular.orderBy("rank_position").limit(limit)


def after_id(events: DataFrame, last_id: int, limit: int | None = None, key: str = "event_id") -> DataFrame:
    """Events with a greater id, ascending; the filter reaches the scan."""
    newer = events.where(F.col(key) > last_id).orderBy(key)
    return newer if limit is None else newer.limit(limit)


def affected_users(events: DataFrame, last_id: int) -> DataFrame:
    return events.where(F.col("event_id") > last_id).select("user_id").distinct()


def session_conflicts(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events whose session was first used by another user."""
    bound = events.groupBy("session_id").agg(F.min_by("user_id", "event_id").alias("bound_user_id"))
    found = join_per_key(events, bound, ["session_id"], ["event_id"], hot_rows=hot_rows)
    return found.where(F.col("user_id") != F.col("bound_user_id"))


def parse_event_time(text) -> Column:
    """Timestamp of ISO text, with or without a final Z; NULL when it cannot be read."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
