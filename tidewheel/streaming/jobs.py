"""Streaming jobs over login and watch events.

Each job is one query with its own checkpoint, so offsets, state and progress are
Spark's.  File sinks are keyed by batch id: a batch that is run again after a failure
overwrites what it wrote the first time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.operators import events, ingest, profiles
from tidewheel.session import cut_lineage
from tidewheel.sources import files
from tidewheel.sources.sinks import last_batch_before, merge_days, newest_rows, stringify, write_batch, write_parquet
from tidewheel.sources.versions import VersionedDataset
from tidewheel.streaming.state import RecentWatches, SESSION_STATE, SessionGroups, as_aggregates


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def start(
    df: DataFrame,
    root: str,
    mode: str,
    handle: Callable[[DataFrame, int], None],
    interval: str | None = None,
) -> StreamingQuery:
    """Run a job batch by batch; without an ``interval`` it stops when the input is used up.

    State lives in RocksDB, on the executors' disks instead of their heaps, unless the session
    names another store.
    """
    conf = df.sparkSession.conf
    if conf.get(STATE_STORE, HEAP_STORE) == HEAP_STORE:
        conf.set(STATE_STORE, ROCKSDB)
    writer = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(handle)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def window_stats(
    stream: DataFrame, minutes: int = 5, short_seconds: float = 10.0, lateness: str | None = None
) -> DataFrame:
    """Counters per window of finished watches, in update mode.

    Without ``lateness`` an old window is corrected however late an event comes, and one
    small row of state per window is kept for good.  With it (say '1 day') state is
    dropped once the watermark has passed, and so are events later than that; this
    needs a window length that divides the hour.
    """
    done = events.finished(stream)
    if lateness is None:
        start_time = events.window_start("event_time", minutes)
        return done.groupBy(start_time.alias("window_start")).agg(*events.window_counters(short_seconds))
    if 60 % minutes:
        raise ValueError("a lateness bound needs windows that divide the hour")
    bounded = done.withWatermark("event_time", lateness)
    return (
        bounded.groupBy(F.window("event_time", f"{minutes} minutes").alias("w"))
        .agg(*events.window_counters(short_seconds))
        .select(F.col("w.start").alias("window_start"), "total_count", "abnormal_count")
    )


GROUPS = 4096


def session_rows(
    stream: DataFrame, retention: timedelta = timedelta(days=7), lateness: str = "1 day", groups: int = GROUPS
) -> DataFrame:
    """State of the sessions that an ``events.activity`` stream changes, in update mode.

    A session leaves the store once the watermark is ``retention`` past the logout that closed
    it; a login or watch before that takes it up again.  A later event opens a new row, told
    apart by ``opened_by``, the smallest event id of the batch that opened it.  Sessions that
    were never closed stay.  Events later than ``lateness`` are dropped.

    The sessions are kept in ``groups``, by a hash of their ids: a batch reads and writes the groups
    that it touches.  Their number is fixed for a checkpoint; a few thousand sessions in each
    cost less than the calls for the group.
    """
    timed = stream.where("event_time is not null").withWatermark("event_time", lateness).withColumn("at", F.unix_micros("event_time"))
    keyed = timed.withColumn("group", F.pmod(F.xxhash64("session_id"), F.lit(groups)).cast("int")).groupBy("group")
    return keyed.transformWithState(SessionGroups(retention), f"session_id string, {SESSION_STATE}", "Update", "EventTime")


def user_aggregates(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").agg(*events.user_aggregates())


def run_window_stats(stream, root: str, interval=None, **options) -> StreamingQuery:
    """Totals of the windows that each batch changes, kept by day."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        _keep_windows(batch, root, batch_id)

    return start(window_stats(stream, **options), root, "update", merge, interval)


def _keep_windows(rows: DataFrame, root: str, batch_id: int, sums=()) -> None:
    dated = cut_lineage(rows.withColumn("day", F.to_date("window_start")))
    merge_days(dated, f"{root}/stats", ["window_start"], "day", batch_id, sums)


def run_sessions(activity, root: str, interval=None, **options) -> StreamingQuery:
    return start(session_rows(activity, **options), root, "update", lambda df, n: write_batch(df, f"{root}/sessions", n), interval)


def run_users(activity, root: str, interval=None) -> StreamingQuery:
    return start(user_aggregates(activity), root, "update", lambda df, n: write_batch(df, f"{root}/users", n), interval)


def read_window_stats(spark, root: str, minutes: int = 5) -> DataFrame:
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    rows = spark.read.parquet(f"{root}/stats")
    return rows.select("window_start", (F.col("window_start") + length).alias("window_end"), "total_count", "abnormal_count")


def read_sessions(spark, root: str) -> DataFrame:
    """The sessions; one that was opened anew after it had left the store has several rows."""
    return events.session_state(as_aggregates(newest_rows(spark, f"{root}/sessions", ["session_id", "opened_by"])))


def read_users(spark, root: str) -> DataFrame:
    return events.user_state(newest_rows(spark, f"{root}/users", ["user_id"]))


def run_additive_stats(stream: DataFrame, root: str, minutes: int = 5, short_seconds: float = 10.0,
                       interval=None) -> StreamingQuery:
    """Window counters without state: each batch's counts are added to those of its days."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        counted = events.window_stats(events.finished(batch), minutes, short_seconds).drop("window_end")
        _keep_windows(counted, root, batch_id, ["total_count", "abnormal_count"])

    return start(stream, root, "append", merge, interval)


def run_popular(stream: DataFrame, root: str, limit: int = 50, interval=None) -> StreamingQuery:
    """The top items over the whole history, from the totals that each batch changes.

    Beside the top, a bound is kept: no item outside it was better when it was last compared.
    The new top is found among the old one and the changed items.  It is right if its last
    item is not below the bound, which holds unless totals fall (watches of negative length);
    then all totals written so far are ranked anew.  Per batch at most the changed items and
    ``limit`` + 1 rows are written.
    """
    totals = stream.groupBy("movie_id").agg(
        F.sum("watch_duration_seconds").alias("score"), F.count(F.lit(1)).alias("watch_count")
    )
    worth = F.struct(F.col("score").alias("score"), F.col("watch_count").alias("watch_count"), (-F.col("movie_id")).alias("less_id"))

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = spark.read.parquet(write_batch(batch.where("movie_id is not null"), f"{root}/totals", batch_id))
        last = last_batch_before(spark, f"{root}/popular", batch_id)
        found, bound = changed, None
        if last is not None:
            old = spark.read.parquet(last)
            bound = old.agg(F.max("bound").alias("bound")).first()["bound"]
            found = old.select(*changed.columns).join(changed, "movie_id", "left_anti").unionByName(changed)
        top = events.rank_items(found, limit + 1).select("*", worth.alias("worth")).orderBy("rank_position").collect()
        kept = top[:limit]
        if bound is not None and (len(kept) < limit or tuple(kept[-1]["worth"]) < tuple(bound)):
            known = newest_rows(spark, f"{root}/totals", ["movie_id"])
            top = events.rank_items(known, limit + 1).select("*", worth.alias("worth")).orderBy("rank_position").collect()
            bound = None
        outside = [tuple(r["worth"]) for r in top[limit:]] + ([tuple(bound)] if bound is not None else [])
        best = max(outside, default=None)
        rows = [(r["movie_id"], r["score"], r["watch_count"], r["rank_position"], best) for r in top[:limit]]
        schema = "movie_id long, score double, watch_count long, rank_position int, bound struct<score:double,watch_count:long,less_id:long>"
        write_batch(spark.createDataFrame(rows, schema).coalesce(1), f"{root}/popular", batch_id)

    return start(totals, root, "update", refresh, interval)


def read_popular(spark, root: str) -> DataFrame:
    return spark.read.parquet(last_batch_before(spark, f"{root}/popular")).drop("bound")


def run_embedding_refresh(
    stream: DataFrame,
    root: str,
    items: DataFrame,
    limit: int = 200,
    hours: int = 720,
    min_watch: float = 30.0,
    interval=None,
) -> StreamingQuery:
    """New vectors for the users of each batch, from their recent history.

    The history, at most ``limit`` events, and the batch of the user's last vector are the
    user's state, so a batch reads its own events and its users' state only.  Per batch one
    version folder is written (the vectors as JSON text), one set of snapshot rows with their
    lineage, and a manifest; the look-back ends at the batch's newest event.
    """
    spark = stream.sparkSession
    timed = stream.where("event_time is not null").withColumn("at", F.unix_micros("event_time"))
    recent = timed.groupBy("user_id").transformWithState(RecentWatches(limit), RecentWatches.OUT, "Update", "None")

    def refresh(batch: DataFrame, batch_id: int) -> None:
        history = cut_lineage(batch.withColumn("event_time", F.timestamp_micros("at")))
        newest = history.agg(F.timestamp_micros(F.max("newest")).alias("t")).first()["t"]
        if newest is None:
            return
        version = f"{newest:%Y-%m-%d-%H-%M}"
        write_batch(spark.createDataFrame([(version,)], "version string"), f"{root}/names", batch_id)
        names = spark.read.parquet(f"{root}/names").select(F.col("batch_id").cast("long").alias("previous_batch"), F.col("version").alias("previous_version"))
        before = history.groupBy("user_id").agg(F.max("previous_batch").alias("previous_batch")).join(names, "previous_batch", "left")
        made = profiles.watch_profile(history, items, F.lit(newest), None, limit, hours, min_watch)
        made = made.join(before.drop("previous_batch"), "user_id", "left")
        made = made.withColumn("embedding_version", F.lit(version)).withColumn("updated_at", F.lit(newest))
        path = f"{root}/versions/{version}/batch_id={batch_id}"
        write_parquet(
            made.select(
                "user_id", F.col("embedding_version").alias("version"), "previous_version",
                F.to_json("embedding").alias("embedding"), F.col("updated_at").alias("created_at"),
                "source_event_count", "source_event_max_id",
            ),
            path,
        )
        written = spark.read.parquet(path)
        snapshots = written.select(
            "user_id", F.lit(path).alias("embedding_uri"), F.col("version").alias("embedding_version"),
            "source_event_max_id", "source_event_count", F.col("created_at").alias("updated_at"),
            "previous_version",
        )
        write_parquet(snapshots, f"{root}/snapshots/batch_id={batch_id}")
        summary = profiles.refresh_summary(written).first()
        files.write_json(
            spark, f"{root}/versions/{version}/manifest.json", {"version": version, **summary.asDict()}
        )
        files.write_json(spark, f"{root}/latest.json", {"version": version, "batch_id": batch_id})

    return start(recent, root, "update", refresh, interval)


def tagged(auth: DataFrame, user: DataFrame) -> DataFrame:
    """Both event streams in one, with a ``kind`` column."""
    return auth.withColumn("kind", F.lit("auth_events")).unionByName(
        user.withColumn("kind", F.lit("user_events")), allowMissingColumns=True
    )


def run_export(
    both: DataFrame, root: str, columns: dict[str, list[str]], interval=None
) -> StreamingQuery:
    """Each batch of a ``tagged`` stream as one dated version with a folder per kind.

    The version name is fixed by the first attempt at a batch, so a repeat writes to the
    same folders.  Empty batches make no version.
    """
    spark = both.sparkSession
    dataset = VersionedDataset(spark, root)

    def export(batch: DataFrame, batch_id: int) -> None:
        counts = {r["kind"]: r["count"] for r in batch.groupBy("kind").count().collect()}
        if not counts:
            return
        note = f"{root}/batches/{batch_id}.json"
        name = files.read_json(spark, note, {}).get("version")
        if name is None:
            # two batches within one second still get different names
            taken = {dataset._name(e) for e in dataset.registry()["versions"]}
            now = datetime.now(timezone.utc)
            name = f"{now:%Y%m%d%H%M%S}"
            while name in taken:
                name = f"{int(name) + 1:014d}"
            files.write_json(spark, note, {"version": name})
        for kind in counts:
            rows = batch.where(F.col("kind") == kind).select(*columns[kind])
            write_parquet(stringify(rows), f"{dataset.folder(name)}/{kind}")
        dataset.commit({"version": name, "rows": counts, "batch_id": batch_id})

    return start(both, root, "append", export, interval)


def run_ingest(batches: DataFrame, root: str, interval=None) -> StreamingQuery:
    """Take in or refuse whole ingest batches: rows by verdict and kind, a report per batch.

    Sessions bound by earlier micro-batches are read back from ``root/bindings``, so verdicts
    do not depend on how files fall into micro-batches.  All folders are keyed by the
    micro-batch; a repeated one overwrites its own and ignores what it bound before.
    """
    spark = batches.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        folder = f"{root}/bindings"
        known = None
        if files.has_parquet(spark, folder):
            known = spark.read.parquet(folder).where(F.col("micro_batch") < batch_id).drop("micro_batch")
        rows = ingest.parse_batches(batch, known)
        judged = cut_lineage(ingest.with_verdicts(batch, rows))
        new = ingest.new_bindings(judged)
        if known is not None:
            new = new.join(known.select("session_id"), "session_id", "left_anti")
        write_parquet(judged, f"{root}/rows/micro_batch={batch_id}", partition_by=["batch_ok", "kind"])
        write_parquet(ingest.batch_report(batch, rows), f"{root}/reports/micro_batch={batch_id}")
        write_parquet(new, f"{folder}/micro_batch={batch_id}")

    return start(batches, root, "append", take, interval)
