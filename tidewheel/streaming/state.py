"""Keyed state of the streaming jobs: sessions that leave the store, and recent watches.

Processors for ``transformWithState``.  Spark partitions, stores and recovers the
state; the code here folds a key's new rows into its small state.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from datetime import timedelta

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOMENTS = ("created", "last_login", "last_logout")
# Times are microseconds, so that no time zone takes part between Spark and Python.
SESSION_STATE = (
    "opened_by long, created_at long, created_id long, first_user long, last_login_at long, last_login_id long, "
    "login_user long, last_logout_at long, last_logout_id long, event_count long, total_watch_duration_seconds double, "
    "finish_id long, finish_at long"
)
SESSION_FIELDS = [part.split()[0] for part in SESSION_STATE.split(", ")]
LOGOUT = SESSION_FIELDS.index("last_logout_at")

WATCH = "event_id long, at long, movie_id long, watch_duration_seconds double"
WATCH_FIELDS = [part.split()[0] for part in WATCH.split(", ")]


def _rank(number: int | None) -> float | int:
    """Where an id stands among others; a missing one is before all, as Spark orders nulls."""
    return float("-inf") if number is None else number


def _later(state: dict, name: str, at: int, number: int | None) -> bool:
    """Whether (at, number) is after the moment ``name`` of the state, if it has one."""
    return state[f"{name}_at"] is None or (at, _rank(number)) > (state[f"{name}_at"], _rank(state[f"{name}_id"]))


def fold_session(state: dict | None, rows: Iterable[Row]) -> dict:
    """A session's state with more of its events; the order of events does not matter."""
    rows = list(rows)
    if state is None:
        state = dict.fromkeys(SESSION_FIELDS)
        ids = [row.event_id for row in rows if row.event_id is not None]
        state |= {"opened_by": min(ids, default=None), "event_count": 0, "total_watch_duration_seconds": 0.0}
    for row in rows:
        number, kind, at, seconds = row.event_id, row.event_type, row.at, row.watch_duration_seconds
        if kind == "logout":
            if _later(state, "last_logout", at, number):
                state |= {"last_logout_at": at, "last_logout_id": number}
            continue
        if state["created_at"] is None or not _later(state, "created", at, number):
            state |= {"created_at": at, "created_id": number, "first_user": row.user_id}
        if kind == "login":
            if _later(state, "last_login", at, number):
                state |= {"last_login_at": at, "last_login_id": number, "login_user": row.user_id}
        else:
            state["event_count"] += 1
            state["total_watch_duration_seconds"] += 0.0 if seconds is None or math.isnan(seconds) else seconds
            if state["finish_at"] is None or _rank(number) > _rank(state["finish_id"]):
                state |= {"finish_id": number, "finish_at": at}
    return state


def closed_at(state: dict) -> int | None:
    """When the session was closed for good so far: its last logout, if nothing opened it later."""
    if state["created_at"] is None or state["last_logout_at"] is None:
        return None
    logout = (state["last_logout_at"], _rank(state["last_logout_id"]))
    last = state["last_login_at"] is None or logout > (state["last_login_at"], _rank(state["last_login_id"]))
    return logout[0] if last and logout > (state["created_at"], _rank(state["created_id"])) else None


class Sessions(StatefulProcessor):
    """One state per session, dropped ``retention`` after the logout that closed it.

    Rows come and go as plain values, and a session costs one read and one write of its state:
    frames for a handful of rows, and asking Spark for its timers, took most of the time.  The
    timer follows from the state, so it is touched only when it moves.
    """

    OUT = Row("session_id", *SESSION_FIELDS)

    def __init__(self, retention: timedelta):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", SESSION_STATE)

    def due(self, state: dict | None) -> int | None:
        """When the session leaves the store, in milliseconds; None while it is open."""
        closed = None if state is None else closed_at(state)
        return None if closed is None else closed // 1000 + int(self.retention.total_seconds() * 1000)

    def _known(self) -> dict | None:
        values = self.state.get()
        return None if values is None else dict(zip(SESSION_FIELDS, values))

    def _move_timer(self, before: int | None, after: int | None) -> None:
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._known()
        before = self.due(state)
        state = fold_session(state, rows)
        self.state.update(tuple(state[f] for f in SESSION_FIELDS))
        self._move_timer(before, self.due(state))
        yield self.OUT(key[0], *[state[f] for f in SESSION_FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A timer of a run with another retention may come too early or too late.
        due, now = self.due(self._known()), expiredTimerInfo.getExpiryTimeInMs()
        if due is not None and due > now:
            self.handle.registerTimer(due)
        elif due is not None:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class SessionGroups(Sessions):
    """``Sessions`` by groups: a group's sessions are one value of state, with one timer for the
    session that leaves first.

    Spark takes the rows of a key from Python as an Arrow batch of their own, beside a few calls
    for its state, about 2 ms a key.  That is per group and batch here, not per session.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "sessions binary")

    def _held(self) -> dict[str | None, tuple]:
        values = self.state.get()
        return {} if values is None else pickle.loads(values[0])

    def _first_due(self, held: dict[str | None, tuple]) -> int | None:
        return min((due for due in map(self._due, held.values()) if due is not None), default=None)

    def _due(self, values: tuple) -> int | None:
        # most were never closed, which their logout tells
        return None if values[LOGOUT] is None else self.due(dict(zip(SESSION_FIELDS, values)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, new = self._held(), defaultdict(list)
        before = self._first_due(held)
        for row in rows:
            new[row.session_id].append(row)
        for session, its in new.items():
            values = held.get(session)
            state = fold_session(None if values is None else dict(zip(SESSION_FIELDS, values)), its)
            held[session] = tuple(state[f] for f in SESSION_FIELDS)
        self.state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        self._move_timer(before, self._first_due(held))
        for session in new:
            yield self.OUT(session, *held[session])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, fired = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        passed = max(fired + 1, timerValues.getCurrentWatermarkInMs())
        kept = {s: values for s, values in held.items() if (due := self._due(values)) is None or due >= passed}
        if len(kept) < len(held):
            if kept:
                self.state.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))
            else:
                self.state.clear()
        after = self._first_due(kept)
        if after is not None:
            self.handle.registerTimer(after)
        return iter(())


def as_aggregates(rows: DataFrame) -> DataFrame:
    """Rows of ``Sessions`` with the columns of ``events.session_aggregates``."""

    def moment(name: str, *more):
        fields = [F.timestamp_micros(f"{name}_at").alias("event_time"), F.col(f"{name}_id").alias("event_id"), *more]
        return F.when(F.col(f"{name}_at").isNotNull(), F.struct(*fields))

    return rows.select(
        "session_id", "opened_by",
        *[moment(name).alias(name) for name in MOMENTS],
        moment("last_login", F.col("login_user").alias("user_id")).alias("login_user"),
        moment("created", F.col("first_user").alias("user_id")).alias("first_user"),
        "event_count", "total_watch_duration_seconds",
        F.when(F.col("finish_id").isNotNull(), F.struct(F.col("finish_id").alias("event_id"), F.timestamp_micros("finish_at").alias("event_time"))).alias("last_finish"),
    )


class RecentWatches(StatefulProcessor):
    """The latest ``limit`` events of each user, and the batch that last changed them.

    For every user of a batch the state's events come out, with that earlier batch and the
    newest time among the user's new events.  Rows are plain values, as in ``Sessions``.
    """

    OUT = f"user_id long, {WATCH}, previous_batch long, newest long"
    ROW = Row("user_id", *WATCH_FIELDS, "previous_batch", "newest")

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", WATCH)
        self.batch = handle.getValueState("batch", "batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, newest = [], None
        before = self.batch.get()
        if before is not None:
            known = list(self.recent.get())
        for row in rows:
            known.append(tuple(row[f] for f in WATCH_FIELDS))
            newest = row.at if newest is None else max(newest, row.at)
            if len(known) >= 2 * self.limit + 1000:
                known = self._latest(known)
        known = self._latest(known)
        self.recent.put(known)
        self.batch.update((int(TaskContext.get().getLocalProperty("streaming.sql.batchId")),))
        for watch in known:
            yield self.ROW(key[0], *watch, None if before is None else before[0], newest)

    def _latest(self, watches: list[tuple]) -> list[tuple]:
        return sorted(watches, key=lambda w: (w[1], _rank(w[0])), reverse=True)[: self.limit]

    def close(self) -> None:
        pass
