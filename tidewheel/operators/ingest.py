"""Ingest batches: bodies to typed rows, and a verdict per batch, all or nothing.

A batch is a JSON object with the lists ``auth_events`` and ``user_events``.  A missing or
empty value counts as an empty list, a body that is no JSON as an empty object; both are
taken in with 0 events, and the report names the second.  A batch is refused as a whole if
the body or a list is of another kind, or if any event is bad.  Logins and watch events bind
their session to the user; only batches that are taken in bind, in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.operators.events import parse_event_time
from tidewheel.operators.ordering import number_rows
from tidewheel.session import cut_lineage

AUTH_FIELDS = "user_id string, session_id string, event_type string, event_time string"
USER_FIELDS = "user_id string, movie_id string, session_id string, event_time string, watch_duration_seconds string"
KINDS = {"auth": AUTH_FIELDS, "user": USER_FIELDS}
EMPTY = ("", "null", "false", "0", "{}", "[]", '""')


def _bodies(batches: DataFrame) -> DataFrame:
    """batch_id, both lists as arrays of raw JSON texts, and what is wrong with the body."""
    body = F.trim(F.coalesce("body", F.lit("")))
    raw = F.from_json(
        body, "auth_events string, user_events string, _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    lists = F.from_json(body, "auth_events array<string>, user_events array<string>")
    parsed = batches.select("batch_id", body.alias("body"), raw.alias("raw"), lists.alias("lists"))
    kind_of = {}
    for kind in KINDS:
        text, listed = F.col(f"raw.{kind}_events"), F.col(f"lists.{kind}_events")
        kind_of[kind] = F.when(~F.coalesce(text, F.lit("")).isin(*EMPTY) & listed.isNull(), F.lit("not_a_list"))
    is_object, empty = F.col("body").startswith("{"), F.col("body").isin(*EMPTY)
    problem = (
        F.when(~empty & ~is_object & F.col("body").rlike(r'^(\[.*\]|".*"|-?[0-9.eE+-]+|true)$'), "not_an_object")
        .when(~empty & (~is_object | F.col("raw._bad").isNotNull()), "not_json")
        .otherwise(F.coalesce(kind_of["auth"], kind_of["user"]))
    )
    return parsed.select("batch_id", "lists.auth_events", "lists.user_events", problem.alias("body_problem"))


def _events_of(bodies: DataFrame, kind: str) -> DataFrame:
    listed = bodies.where(F.col("body_problem").isNull()).select(
        "batch_id", F.posexplode(f"{kind}_events").alias("position", "text")
    )
    e = F.from_json("text", KINDS[kind])
    text = lambda name: F.col(f"e.{name}") if f"{name} string" in KINDS[kind] else F.lit(None).cast("string")
    return listed.select("batch_id", "position", e.alias("e"), F.trim("text").startswith("{").alias("is_object")).select(
        "batch_id", F.lit(kind).alias("kind"), "position", F.coalesce("is_object", F.lit(False)).alias("is_object"),
        text("user_id").try_cast("long").alias("user_id"),
        text("movie_id").try_cast("long").alias("movie_id"),
        text("session_id").alias("session_id"),
        (text("event_type") if kind == "auth" else F.lit("finish")).alias("event_type"),
        parse_event_time(text("event_time")).alias("event_time"),
        text("watch_duration_seconds").try_cast("double").alias("watch_duration_seconds"),
    )


def _format_problem() -> Column:
    is_user = F.col("kind") == "user"
    return (
        F.when(~F.col("is_object"), "not_an_object")
        .when(F.col("user_id").isNull(), "user_id")
        .when(F.col("session_id").isNull(), "session_id")
        .when(~is_user & ~F.coalesce(F.col("event_type").isin("login", "logout"), F.lit(False)), "event_type")
        .when(F.col("event_time").isNull(), "event_time")
        .when(is_user & F.col("movie_id").isNull(), "movie_id")
        .when(is_user & F.col("watch_duration_seconds").isNull(), "watch_duration_seconds")
    )


def _binds() -> Column:
    return (F.col("kind") == "user") | (F.col("event_type") == "login")


def settle(binding: DataFrame, bound: DataFrame) -> tuple[DataFrame, int]:
    """Batches (batch_id) of ``binding`` that use a session of another user, and the rounds taken.

    ``binding`` holds the binding events of contested sessions only, in batches without other
    faults.  A batch that uses a session with two users, or one bound before to another user,
    is refused.  Of the others one is refused if and only if an earlier one that is taken in
    uses a session of it with another user.  Per round:

    1.  A batch without earlier open batches against it is taken in.
    2.  A batch with exactly one against it has that one's opposite verdict: a link.  Links are
        followed by doubling, so a chain of any length is settled in a number of steps that
        grows with its logarithm.
    3.  What conflicts with a batch taken in is refused.

    Further rounds are needed only where batches wait for several others at once.
    """
    keys = ["session_id", "batch_id"]
    each = binding.groupBy(*keys).agg(F.min("user_id").alias("user_id"), F.max("user_id").alias("_other"))
    bad = (F.col("_other") != F.col("user_id")) | F.coalesce(F.col("bound_user_id") != F.col("user_id"), F.lit(False))
    each = cut_lineage(each.join(bound, "session_id", "left").select(*keys, "user_id", bad.alias("bad"), F.col("bound_user_id").isNotNull().alias("known")))
    refused = [cut_lineage(each.where("bad").select("batch_id").distinct())]
    rows = cut_lineage(each.where("not known").join(refused[0], "batch_id", "left_anti").select(*keys, "user_id"))
    rounds = 0
    while not rows.isEmpty():
        rounds += 1
        waits = cut_lineage(_waits(rows))
        free = waits.where("lowest is null").select("batch_id", F.lit(True).alias("ok"))
        links = waits.where("lowest is not null and single").select("batch_id", F.col("lowest").alias("root"), F.lit(True).alias("flip"))
        while True:
            rounds += 1
            via = links.select(F.col("batch_id").alias("via"), F.col("root").alias("beyond"), F.col("flip").alias("more"))
            step = cut_lineage(
                links.join(via, F.col("root") == F.col("via"), "left").select(
                    "batch_id", F.coalesce("beyond", "root").alias("root"),
                    (F.col("flip") != F.coalesce("more", F.lit(False))).alias("flip"), F.col("beyond").isNotNull().alias("moved"),
                )
            )
            links = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        rooted = links.join(free.select(F.col("batch_id").alias("root")), "root").select("batch_id", (~F.col("flip")).alias("ok"))
        new = cut_lineage(free.union(rooted))
        owners = cut_lineage(rows.join(new.where("ok"), "batch_id").groupBy("session_id").agg(F.min("user_id").alias("owner")))
        left = rows.join(new, "batch_id", "left_anti")
        clash = cut_lineage(left.join(owners, "session_id").where("user_id <> owner").select("batch_id").distinct())
        refused += [new.where("not ok").select("batch_id"), clash]
        rows = cut_lineage(left.join(clash, "batch_id", "left_anti"))
    found = refused[0]
    for more in refused[1:]:
        found = found.union(more)
    return found, rounds


def _waits(rows: DataFrame) -> DataFrame:
    """Per batch of (session_id, batch_id, user_id): the lowest earlier batch that shares a
    session with another user, and whether that is the only one."""
    first = cut_lineage(rows.groupBy("session_id").agg(F.min(F.struct("batch_id", "user_id")).alias("first")))
    mine = F.col("user_id") == F.col("first.user_id")
    other = cut_lineage(rows.join(first, "session_id").where(~mine).groupBy("session_id").agg(F.min("batch_id").alias("other")))
    counted = number_rows(rows, ["session_id"], ["batch_id"], "_all")
    counted = cut_lineage(number_rows(cut_lineage(counted), ["session_id", "user_id"], ["batch_id"], "_own"))
    lowest = F.when(~mine, F.col("first.batch_id")).when(F.col("other") < F.col("batch_id"), F.col("other"))
    return (
        counted.join(first, "session_id").join(other, "session_id", "left")
        .select("batch_id", lowest.alias("lowest"), (F.col("_all") - F.col("_own")).alias("against"))
        .groupBy("batch_id")
        .agg(
            F.min("lowest").alias("lowest"),
            ((F.max("against") <= 1) & (F.min("lowest") == F.max("lowest"))).alias("single"),
        )
    )


def parse_batches(batches: DataFrame, bound_sessions: DataFrame | None = None) -> DataFrame:
    """One row per event of ingest batches (batch_id, body as JSON text), with ``problem``.

    ``bound_sessions`` (session_id, bound_user_id) are sessions bound before.
    """
    spark = batches.sparkSession
    bound = bound_sessions if bound_sessions is not None else spark.createDataFrame([], "session_id string, bound_user_id long")
    bound = bound.select("session_id", "bound_user_id")
    bodies = _bodies(batches)
    events = cut_lineage(
        _events_of(bodies, "auth").unionByName(_events_of(bodies, "user")).withColumn("problem", _format_problem()).drop("is_object")
    )
    faulty = bodies.where("body_problem is not null").select("batch_id").union(
        events.where("problem is not null").select("batch_id")
    )
    formed = events.where(_binds() & F.col("problem").isNull())
    sound = formed.join(faulty.distinct(), "batch_id", "left_anti")
    users = formed.select("session_id", "user_id").union(bound.select("session_id", "bound_user_id"))
    contested = users.groupBy("session_id").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).where("a <> b")
    binding = cut_lineage(sound.join(contested, "session_id", "left_semi"))
    if binding.isEmpty():
        return events
    at = F.struct("batch_id", "kind", "position")
    first = F.min(F.struct(at.alias("at"), "user_id"))
    taken = binding.join(settle(binding, bound)[0], "batch_id", "left_anti")
    owners = (
        binding.select("session_id").distinct()
        .join(taken.groupBy("session_id").agg(first.alias("binder")), "session_id", "left")
        .join(bound, "session_id", "left")
    )
    # within a refused batch its own first event binds the ones after it
    own = binding.groupBy("session_id", "batch_id").agg(first.alias("own"))
    found = events.join(cut_lineage(owners), "session_id", "left").join(own, ["session_id", "batch_id"], "left")
    owner = F.coalesce(
        "bound_user_id", F.when(F.col("binder.at") <= at, F.col("binder.user_id")), F.when(F.col("own.at") <= at, F.col("own.user_id"))
    )
    clash = F.when(_binds() & (owner != F.col("user_id")), "session_bound_to_other_user")
    return found.select(
        *[c for c in events.columns if c != "problem"], F.coalesce("problem", clash).alias("problem")
    )


def batch_report(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Per batch: events, bad events, whether it was taken in, and the body's problem."""
    counts = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("events"), F.count("problem").alias("bad_events"))
    body = F.col("body_problem")
    return (
        _bodies(batches).select("batch_id", "body_problem").join(counts, "batch_id", "left")
        .select(
            "batch_id",
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("bad_events", F.lit(0)).alias("bad_events"),
            ((F.coalesce("bad_events", F.lit(0)) == 0) & (body.isNull() | (body == "not_json"))).alias("accepted"),
            "body_problem",
        )
    )


def with_verdicts(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``batch_ok``, whether their batch was taken in."""
    verdicts = batch_report(batches, rows).select("batch_id", F.col("accepted").alias("batch_ok"))
    return rows.join(verdicts, "batch_id")


def new_bindings(rows: DataFrame) -> DataFrame:
    """(session_id, bound_user_id) of the sessions that accepted rows use first."""
    return (
        rows.where(_binds() & F.col("batch_ok"))
        .groupBy("session_id")
        .agg(F.min(F.struct(F.struct("batch_id", "kind", "position").alias("at"), "user_id"))["user_id"].alias("bound_user_id"))
    )
