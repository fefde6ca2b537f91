"""Streaming jobs run to the end of the given tables, their results read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.operators import events
from tidewheel.plans import sqltext as s
from tidewheel.plans.rating_queries import exploded
from tidewheel.plans.event_queries import INGEST, POPULAR, SESSIONS, USERS, WINDOWS, epoch, sessions_out, users_out
from tidewheel.session import shared_folder
from tidewheel.sources import sinks, tables
from tidewheel.streaming import jobs


PARTS = 3


def _root(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _in_parts(spark, folder, root, parts: int = PARTS):
    """The events as a stream of ``parts`` micro-batches, cut at equal spans of time.

    Each part is written as the same number of files, so that a batch takes exactly one part.
    """
    raw = tables.table(spark, folder, "events")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    span = raw.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    width = (span["hi"] or 0) - (span["lo"] or 0) + 1
    each = 1 + span["n"] // 1_000_000
    for i in range(parts):
        part = raw.where(F.floor((time - (span["lo"] or 0)) * parts / width) == i)
        part.repartition(each).write.mode("append").parquet(f"{root}/input")
    return jobs.file_stream(spark, f"{root}/input", raw.schema, each)


def _activity(raw):
    # one source, not a union of two: the events table is read once per batch
    time = F.col("ts").cast("timestamp")
    kind = (
        F.when(F.col("event_type") == "signup", "login")
        .when(F.col("event_type") == "error", "logout")
        .otherwise("finish")
    )
    return raw.select(
        "event_id",
        "user_id",
        F.concat_ws("-", "user_id", F.date_format(time, "yyyyMMdd")).alias("session_id"),
        kind.alias("event_type"),
        time.alias("event_time"),
        F.when(kind == "finish", F.col("value")).otherwise(0.0).alias("watch_duration_seconds"),
    )


def _stats_out(df):
    return df.select(
        epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"),
        "total_count", "abnormal_count",
    )


def stream_window_stats(spark, folder):
    root = _root(spark, "window-stats")
    jobs.run_window_stats(tables.shape_user_events(_in_parts(spark, folder, root)), root).awaitTermination()
    return _stats_out(jobs.read_window_stats(spark, root))


def stream_additive_stats(spark, folder):
    root = _root(spark, "additive-stats")
    jobs.run_additive_stats(tables.shape_user_events(_in_parts(spark, folder, root)), root).awaitTermination()
    return _stats_out(jobs.read_window_stats(spark, root))


def stream_sessions(spark, folder):
    root = _root(spark, "sessions")
    jobs.run_sessions(_activity(_in_parts(spark, folder, root)), root).awaitTermination()
    return sessions_out(jobs.read_sessions(spark, root))


def stream_user_state(spark, folder):
    root = _root(spark, "users")
    jobs.run_users(_activity(_in_parts(spark, folder, root)), root).awaitTermination()
    return users_out(jobs.read_users(spark, root))


def stream_user_registry(spark, folder):
    """Users of three micro-batches: the first batch's row stays, the last batch's row wins."""
    root = _root(spark, "registry")

    def keep(batch, batch_id: int) -> None:
        seen = batch.where("user_id is not null").groupBy("user_id")
        sinks.insert_absent(seen.agg(F.min("event_id").alias("first_event")), f"{root}/first", ["user_id"], batch_id)
        sinks.upsert(seen.agg(F.max("event_id").alias("last_event")), f"{root}/last", ["user_id"], batch_id)

    jobs.start(tables.shape_user_events(_in_parts(spark, folder, root)), root, "append", keep).awaitTermination()
    first, last = (spark.read.parquet(f"{root}/{n}").drop("batch_id", "bucket") for n in ("first", "last"))
    return first.join(last, "user_id")


def stream_popular(spark, folder):
    root = _root(spark, "popular")
    jobs.run_popular(tables.shape_user_events(_in_parts(spark, folder, root)), root).awaitTermination()
    return jobs.read_popular(spark, root).select(
        "movie_id", F.round("score", 4).alias("score"), "watch_count", "rank_position"
    )


def stream_embedding_refresh(spark, folder):
    """Every vector that one of three micro-batches refreshed, with its lineage."""
    root = _root(spark, "refresh")
    stream = tables.shape_user_events(_in_parts(spark, folder, root))
    jobs.run_embedding_refresh(stream, root, tables.items(spark, folder)).awaitTermination()
    rows = spark.read.parquet(f"{root}/versions/*/batch_id=*").select(
        F.concat_ws("/", "version", "user_id").alias("refreshed"), "version", "previous_version", "user_id",
        "source_event_count", "source_event_max_id", F.from_json("embedding", "array<double>").alias("embedding"),
    )
    values = exploded(rows, "refreshed", "embedding").where("pos % 16 = 0")
    return values.join(rows.drop("embedding"), "refreshed").drop("refreshed")


def stream_export(spark, folder):
    root = _root(spark, "export")
    raw = _in_parts(spark, folder, root)
    auth = tables.shape_auth_events(raw)
    user = events.finished(tables.shape_user_events(raw))
    columns = {"auth_events": auth.columns, "user_events": user.columns}
    jobs.run_export(jobs.tagged(auth, user), root, columns).awaitTermination()
    read = lambda kind: spark.read.parquet(f"{root}/versions/*/{kind}").select(
        F.lit(kind).alias("kind"), "event_id", "user_id", "session_id"
    )
    return read("auth_events").unionByName(read("user_events"))


def stream_ingest(spark, folder):
    """Ingest batches in four files, one per micro-batch, taken in as a stream; events per verdict.

    The files cut the batches in the order of their ids, also between batches that share a
    session.
    """
    from tidewheel.plans.event_queries import ingest_bodies

    root = _root(spark, "ingest")
    bodies = ingest_bodies(spark, folder)
    cuts = bodies.agg(F.max("batch_id")).first()[0] or 0
    for i in range(4):
        part = bodies.where(F.floor(F.col("batch_id") * 4 / (cuts + 1)) == i)
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
    schema = spark.read.parquet(f"{root}/input").schema
    jobs.run_ingest(jobs.file_stream(spark, f"{root}/input", schema, 1), root).awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.groupBy(F.col("batch_ok").cast("boolean").alias("batch_ok"), "kind").agg(F.count(F.lit(1)).alias("events"))


# Per part its newest event, and per user of the part the events to then, looking back from it.
REFRESHES = s.USER_EVENTS + f""",
span AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) - min(epoch_us(event_time)) + 1 AS width FROM user_events),
cut AS (SELECT *, ((epoch_us(event_time) - lo) * {PARTS} // width)::INTEGER AS part FROM user_events, span),
parts AS (SELECT part, max(event_time) AS newest, strftime(max(event_time), '%Y-%m-%d-%H-%M') AS version FROM cut GROUP BY part),
asked AS (
  SELECT *, lag(version) OVER (PARTITION BY user_id ORDER BY part) AS previous_version
  FROM (SELECT DISTINCT user_id, part FROM cut) JOIN parts USING (part)),
known AS (
  SELECT a.part, a.version, a.previous_version, c.*,
         row_number() OVER (PARTITION BY a.part, a.user_id ORDER BY c.event_time DESC, c.event_id DESC) AS recency
  FROM asked a JOIN cut c ON c.user_id = a.user_id AND c.part <= a.part AND c.event_time >= a.newest - INTERVAL 720 HOUR
  QUALIFY recency <= 200),
sources AS (
  SELECT part, user_id, count(*) AS source_event_count, max(event_id) AS source_event_max_id FROM known GROUP BY ALL),
""" + s.VECTORS

QUERIES = {
    "stream_window_stats": (stream_window_stats, "WITH " + WINDOWS.format(m=5, where="WHERE event_type = 'finish'")),
    "stream_additive_stats": (stream_additive_stats, "WITH " + WINDOWS.format(m=5, where="WHERE event_type = 'finish'")),
    "stream_sessions": (stream_sessions, "WITH " + SESSIONS),
    "stream_user_state": (stream_user_state, "WITH " + USERS),
    "stream_user_registry": (stream_user_registry, s.q(s.USER_EVENTS + f""",
span AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) - min(epoch_us(event_time)) + 1 AS width FROM user_events),
cut AS (SELECT *, (epoch_us(event_time) - lo) * {PARTS} // width AS part FROM user_events, span),
each AS (SELECT user_id, part, min(event_id) AS a, max(event_id) AS b FROM cut WHERE user_id IS NOT NULL GROUP BY ALL)""", """
SELECT user_id, arg_min(a, part) AS first_event, arg_max(b, part) AS last_event FROM each GROUP BY user_id""")),
    "stream_popular": (stream_popular, s.q(s.USER_EVENTS + ",\n" + POPULAR, """
SELECT movie_id, round(score, 4) AS score, watch_count, rank_position FROM popular""")),
    "stream_embedding_refresh": (stream_embedding_refresh, s.q(REFRESHES, """
SELECT version, previous_version, user_id, source_event_count, source_event_max_id, pos::BIGINT AS pos,
  round(round(sum(greatest(watch_duration_seconds, 30) * v) / sum(greatest(watch_duration_seconds, 30)), 12)::FLOAT::DOUBLE + 1.23e-6::DOUBLE, 5) AS value
FROM known JOIN item_values USING (movie_id) JOIN sources USING (part, user_id) WHERE pos % 16 = 0 GROUP BY ALL""")),
    "stream_export": (stream_export, s.q(s.USER_EVENTS + ",\n" + s.AUTH_EVENTS, """
SELECT 'auth_events' AS kind, event_id, user_id, session_id FROM auth_events
UNION ALL SELECT 'user_events', event_id, user_id, session_id FROM user_events WHERE event_type = 'finish'""")),
    "stream_ingest": (stream_ingest, s.q(INGEST, """
SELECT accepted AS batch_ok, CASE WHEN is_auth THEN 'auth' ELSE 'user' END AS kind, count(*) AS events
FROM all_rows JOIN verdicts USING (batch_id) GROUP BY 1, 2""")),
}
