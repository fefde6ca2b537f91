"""Event operators against plain loops, and streams against their batch twins."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import events, ingest
from tidewheel.sources import files
from tidewheel.sources.sinks import merge_days
from tidewheel.streaming import jobs

BASE = datetime(2024, 3, 1, 22, 0, 0)
COLUMNS = "event_id long, user_id long, movie_id long, session_id string, event_type string, event_time timestamp, watch_duration_seconds double"


def stream_rows(n=240, seed=21):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.33 else rnd.randrange(2, 9)
        kind = rnd.choice(["finish", "finish", "finish", "login", "logout"])
        session = f"s{rnd.randrange(12)}"
        time = BASE + timedelta(seconds=rnd.randrange(4 * 3600))
        rows.append((i, user, rnd.randrange(20), session, kind, time, float(rnd.choice([5, 9.99, 10, 400]))))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(stream_rows(), COLUMNS).cache()


def split(df):
    auth = df.where("event_type <> 'finish'").drop("movie_id", "watch_duration_seconds")
    return auth, df.where("event_type = 'finish'")


@pytest.mark.parametrize("minutes", [5, 7, 60, 90])
def test_window_stats(log, minutes):
    got = {r["window_start"]: (r["window_end"], r["total_count"], r["abnormal_count"]) for r in events.window_stats(log, minutes).collect()}
    want = {}
    for r in stream_rows():
        start = r[5].replace(second=0, microsecond=0)
        start -= timedelta(minutes=start.minute % minutes)
        _, a, b = want.get(start, (None, 0, 0))
        want[start] = (start + timedelta(minutes=minutes), a + 1, b + (r[6] < 10))
    assert got == want


def test_window_edges(spark):
    rows = [(1, 1, 1, "s", "finish", datetime(2024, 1, 1, 0, 4, 59, 999000), 9.99),
            (2, 1, 1, "s", "finish", datetime(2024, 1, 1, 0, 5), 10.0)]
    got = events.window_stats(spark.createDataFrame(rows, COLUMNS)).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["total_count"], r["abnormal_count"]) for r in got] == [(0, 1, 1), (5, 1, 0)]


def session_loop(rows):
    state = {}
    for e in sorted(rows, key=lambda r: (r[5], r[0])):
        key, user, kind, time, sec = e[3], e[1], e[4], e[5], e[6]
        if kind in ("login", "finish") and key not in state:
            state[key] = dict(user=user, start=time, end=None, status="active", count=0, total=0.0, first_login=False)
        s = state.get(key)
        if s is None:
            continue
        if kind == "login":
            s.update(user=user, end=None, status="active")
        elif kind == "logout":
            s.update(end=time, status="closed")
        else:
            s["count"] += 1
            s["total"] += sec
    return {k: (s["user"], s["start"], s["end"], s["status"], s["count"], round(s["total"], 6)) for k, s in state.items()}


def sessions_of(df):
    return {
        r["session_id"]: (r["user_id"], r["session_start_time"], r["session_end_time"], r["status"], r["event_count"],
                          round(r["total_watch_duration_seconds"], 6))
        for r in df.collect()
    }


def test_session_stats(log):
    assert sessions_of(events.session_stats(*split(log))) == session_loop(stream_rows())


def test_reactivated_session(spark):
    t = lambda m: BASE + timedelta(minutes=m)
    rows = [(1, 1, None, "a", "login", t(0), None), (2, 1, None, "a", "logout", t(5), None),
            (3, 2, None, "a", "login", t(9), None), (4, 1, None, "b", "logout", t(1), None),
            (5, 3, None, None, "login", t(2), None), (6, 3, None, "", "logout", t(3), None)]
    got = sessions_of(events.session_stats(*split(spark.createDataFrame(rows, COLUMNS))))
    assert got["a"] == (2, t(0), None, "active", 0, 0.0)
    assert "b" not in got  # a logout alone makes no session
    assert got["fallback-3-5"][3] == "active" and "fallback-3-6" not in got


def test_session_conflicts(spark):
    rows = [(1, 1, 1, "a", "finish", BASE, 1.0), (2, 2, 1, "a", "finish", BASE, 1.0), (3, 2, 1, "b", "finish", BASE, 1.0)]
    got = events.session_conflicts(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r["event_id"], r["bound_user_id"]) for r in got] == [(2, 1)]


def test_popular_ties(spark):
    rows = [(i, 1, m, "s", "finish", BASE, w) for i, (m, w) in enumerate([(1, 10.0), (2, 5.0), (2, 5.0), (3, 10.0), (4, 1.0)])]
    got = events.popular_items(spark.createDataFrame(rows, COLUMNS), 3).orderBy("rank_position").collect()
    assert [(r["movie_id"], r["rank_position"]) for r in got] == [(2, 1), (1, 2), (3, 3)]
    assert events.popular_list(events.popular_items(spark.createDataFrame(rows, COLUMNS)), 2).count() == 2


def test_after_id(log):
    assert [r["event_id"] for r in events.after_id(log, 200, 5).collect()] == [201, 202, 203, 204, 205]
    assert events.after_id(log, 200).count() == 39
    want = {r[1] for r in stream_rows() if r[0] > 220}
    assert {r["user_id"] for r in events.affected_users(log, 220).collect()} == want


def body(auth=(), user=()):
    return json.dumps({"auth_events": list(auth), "user_events": list(user)})


def watch(user=1, session="s1", time="2024-01-01T00:00:00Z", sec=5, movie=7):
    return {"user_id": user, "session_id": session, "event_time": time, "watch_duration_seconds": sec, "movie_id": movie}


def login(user=1, session="s1", kind="login", time="2024-01-01T00:00:00+00:00"):
    return {"user_id": user, "session_id": session, "event_type": kind, "event_time": time}


def test_parse_batches(spark):
    bodies = {
        1: body([login()], [watch()]),
        2: body([login(2, "s2")], [watch(2, "s2"), watch(2, "s2", time=None)]),
        3: body([login(3, "s3", kind="reset")]),
        4: body([], [watch(9, "s1")]),
        5: body([], [watch("x", "s5")]),
        6: body([], [watch(6, "s6", sec="many")]),
        7: body([login(7, "known")]),
        8: body([], [watch(8, "s8", movie=None)]),
        9: body([login(9, "s9"), login(9, "s9", kind="logout")], []),
    }
    df = spark.createDataFrame(list(bodies.items()), "batch_id long, body string")
    bound = spark.createDataFrame([("known", 70)], "session_id string, bound_user_id long")
    parsed = ingest.parse_batches(df, bound)
    rows = ingest.with_verdicts(df, parsed).collect()
    ok = {r["batch_id"] for r in rows if r["batch_ok"]}
    assert ok == {1, 9}
    problems = {r["batch_id"]: r["problem"] for r in rows if r["problem"]}
    assert problems == {2: "event_time", 3: "event_type", 4: "session_bound_to_other_user", 5: "user_id",
                        6: "watch_duration_seconds", 7: "session_bound_to_other_user", 8: "movie_id"}
    first = next(r for r in rows if r["batch_id"] == 1 and r["kind"] == "user")
    assert first["event_time"] == datetime(2024, 1, 1) and first["event_type"] == "finish"
    assert {r["batch_id"]: r["accepted"] for r in ingest.batch_report(df, parsed).collect()}[2] is False


BODIES = [
    # (batch, body, accepted, problem of the body)
    (1, "not json", True, "not_json"), (2, '{"auth_events": 5, "user_events": []}', False, "not_a_list"),
    (3, body(), True, None), (4, None, True, None), (5, "[1]", False, "not_an_object"), (6, '"x"', False, "not_an_object"),
    (7, '{"auth_events": [1]}', False, None), (8, '{"user_events": {}}', True, None), (9, "{", True, "not_json"),
    (10, '{"user_events": "a"}', False, "not_a_list"), (11, '{"auth_events": null}', True, None), (12, "5", False, "not_an_object"),
]


def test_bodies_without_events_get_a_verdict(spark):
    df = spark.createDataFrame([b[:2] for b in BODIES], "batch_id long, body string")
    got = {r["batch_id"]: (r["accepted"], r["body_problem"]) for r in ingest.batch_report(df, ingest.parse_batches(df)).collect()}
    assert got == {b[0]: b[2:] for b in BODIES}


BINDING = {
    1: (body([], [watch(1, "s", movie=None)]), False),  # refused: binds nothing
    2: (body([], [watch(2, "s")]), True),
    3: (body([login(1, "s"), login(1, "t")]), False),  # s is bound to 2, so t stays free
    4: (body([login(5, "t")]), True),
    5: (body([], [watch(None, "u")]), False),
    6: (body([], [watch(6, "u"), watch(7, "u")]), False),  # two users in one batch
    7: (body([], [watch(7, "u"), watch(2, "s")]), True),
    8: (body([login(9, "v")], [watch(9, "t")]), False),
    9: (body([login(10, "v")]), True),
    10: (body([login(99, "s", kind="logout")]), True),  # a logout binds nothing
}


def verdicts_of(rows):
    return {r["batch_id"]: r["accepted"] for r in rows}


def test_only_accepted_batches_bind(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in BINDING.items()], "batch_id long, body string")
    report = ingest.batch_report(df, ingest.parse_batches(df)).collect()
    assert verdicts_of(report) == {k: v[1] for k, v in BINDING.items()}


@pytest.mark.parametrize("files_", [1, 3, 10])
def test_verdicts_do_not_depend_on_files(spark, tmp_path, files_):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, v[0]) for k, v in BINDING.items()]
    for i in range(files_):
        part = [r for r in rows if (r[0] - 1) * files_ // len(rows) == i]
        spark.createDataFrame(part, "batch_id long, body string").coalesce(1).write.mode("append").parquet(path)
    jobs.run_ingest(jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1), root).awaitTermination()
    assert verdicts_of(spark.read.parquet(f"{root}/reports").collect()) == {k: v[1] for k, v in BINDING.items()}


def settled_one_by_one(rows):
    """Batches in the order of their ids: refused if a session has another user by then."""
    owner, refused = {}, set()
    for batch in sorted({r[1] for r in rows}):
        mine, clash = dict(owner), False
        for session, _, user in sorted(r for r in rows if r[1] == batch):
            clash |= mine.setdefault(session, user) != user
        if clash:
            refused.add(batch)
        else:
            owner = mine
    return refused


def settled(spark, rows, bound=()):
    df = spark.createDataFrame(rows, "session_id string, batch_id long, user_id long")
    known = spark.createDataFrame(list(bound), "session_id string, bound_user_id long")
    found, rounds = ingest.settle(df, known)
    return {r["batch_id"] for r in found.distinct().collect()}, rounds


def test_chain_of_conflicts_needs_few_rounds(spark):
    """Batch i shares one session with the one before and one with the one after, all users differ."""
    rows = [(f"s{i + k}", i, i) for i in range(200) for k in (0, 1)]
    refused, rounds = settled(spark, rows)
    assert refused == settled_one_by_one(rows) == set(range(1, 200, 2))
    assert rounds <= 12


@pytest.mark.parametrize("seed", [1, 2])
def test_conflicts_equal_one_after_another(spark, seed):
    draw = random.Random(seed)
    rows = [(f"s{draw.randrange(25)}", batch, draw.randrange(3)) for batch in range(60) for _ in range(draw.randint(1, 3))]
    rows += [("hot", batch, batch % 2) for batch in range(0, 60, 3)]
    assert settled(spark, rows)[0] == settled_one_by_one(rows)


# ---- streams -------------------------------------------------------------------------


def write_in_files(df, path, parts, order):
    """The rows as several files, taken by the stream one per batch."""
    for i in range(parts):
        df.where(F.pmod(F.xxhash64(order), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def source(spark, log, tmp_path):
    path = str(tmp_path / "events")
    write_in_files(log, path, 4, "event_id")
    return path


def reading(spark, source):
    return jobs.file_stream(spark, source, spark.read.parquet(source).schema, 1)


def window_rows(df):
    return sorted((r["window_start"], r["window_end"], r["total_count"], r["abnormal_count"]) for r in df.collect())


@pytest.mark.parametrize("minutes", [5, 7])
def test_stream_windows_equal_batch(spark, log, source, tmp_path, minutes):
    root = str(tmp_path / "w")
    jobs.run_window_stats(reading(spark, source), root, minutes=minutes).awaitTermination()
    batch = events.window_stats(events.finished(log), minutes)
    assert window_rows(jobs.read_window_stats(spark, root, minutes)) == window_rows(batch)
    assert files.folders(spark, f"{root}/stats") == ["day=2024-03-01", "day=2024-03-02"]


def test_stream_goes_on_after_restart(spark, log, tmp_path):
    path, root = str(tmp_path / "events"), str(tmp_path / "w")
    log.where("event_id < 100").coalesce(1).write.parquet(path)
    jobs.run_window_stats(reading(spark, path), root).awaitTermination()
    log.where("event_id >= 100").coalesce(1).write.mode("append").parquet(path)
    jobs.run_window_stats(reading(spark, path), root).awaitTermination()
    assert window_rows(jobs.read_window_stats(spark, root)) == window_rows(events.window_stats(events.finished(log)))


def test_lateness_bound_drops_late_events(spark, tmp_path):
    path, root = str(tmp_path / "events"), str(tmp_path / "w")
    row = lambda i, t: (i, 1, 1, "s", "finish", t, 5.0)
    for rows in ([row(1, BASE)], [row(2, BASE + timedelta(hours=3))], [row(3, BASE + timedelta(minutes=1))]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
        jobs.run_window_stats(reading(spark, path), root, lateness="1 hour").awaitTermination()
    assert [r[2] for r in window_rows(jobs.read_window_stats(spark, root))] == [1, 1]
    with pytest.raises(ValueError):
        jobs.window_stats(reading(spark, path), minutes=7, lateness="1 hour")


def test_additive_stats_equal_batch(spark, log, source, tmp_path):
    root = str(tmp_path / "a")
    jobs.run_additive_stats(reading(spark, source), root).awaitTermination()
    assert window_rows(jobs.read_window_stats(spark, root)) == window_rows(events.window_stats(events.finished(log)))
    before = window_rows(jobs.read_window_stats(spark, root))
    again = events.window_stats(events.finished(log)).drop("window_end").withColumn("day", F.to_date("window_start"))
    merge_days(again, f"{root}/stats", ["window_start"], "day", 0, ["total_count", "abnormal_count"])
    assert window_rows(jobs.read_window_stats(spark, root)) == before  # a batch seen before changes nothing


def one_by_one(spark, tmp_path, parts, run):
    """Each list of rows as one file and one run of the query; its progress after each."""
    path, seen = str(tmp_path / "events"), []
    for rows in parts:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
        query = run(reading(spark, path))
        query.awaitTermination()
        seen.append(query.lastProgress)
    return seen


def test_closed_sessions_leave_the_state(spark, tmp_path):
    """Two sessions are closed, one stays open; a day past the retention only that one is kept.
    A login after that opens a new row."""
    t = lambda hours: BASE + timedelta(hours=hours)
    e = lambda i, s, kind, hours, user=1: (i, user, 1, s, kind, t(hours), 5.0)
    parts = [
        [e(1, "a", "login", 0), e(2, "a", "finish", 1), e(3, "a", "logout", 2), e(4, "b", "login", 0), e(5, "b", "logout", 1), e(6, "c", "finish", 1)],
        [e(7, "b", "login", 3)],  # within the retention: the same row again, open
        [e(8, "c", "finish", 60)],  # the watermark passes the end of a
        [e(9, "a", "login", 61, 7), e(10, "b", "logout", 61)],
    ]
    root = str(tmp_path / "s")
    run = lambda stream: jobs.run_sessions(stream, root, retention=timedelta(hours=24), lateness="1 hour")
    seen = one_by_one(spark, tmp_path, parts, run)
    assert len(seen) == len(parts)
    rows = jobs.read_sessions(spark, root).orderBy("session_id", "session_start_time").collect()
    got = [(r["session_id"], r["user_id"], r["session_start_time"], r["status"], r["event_count"]) for r in rows]
    assert got == [("a", 1, t(0), "closed", 1), ("a", 7, t(61), "active", 0), ("b", 1, t(0), "closed", 0), ("c", 1, t(1), "active", 2)]


def test_state_size_falls_after_the_retention(spark, tmp_path):
    t = lambda hours: BASE + timedelta(hours=hours)
    many = [(2 * i + k, i, 1, f"s{i}", kind, t(k), 1.0) for i in range(50) for k, kind in enumerate(["login", "logout"])]
    parts = [many, [(1000, 1, 1, "late", "login", t(100), 1.0)], [(1001, 1, 1, "late", "finish", t(101), 1.0)]]
    root = str(tmp_path / "s")
    run = lambda stream: jobs.run_sessions(stream, root, retention=timedelta(hours=24), lateness="1 hour")
    seen = one_by_one(spark, tmp_path, parts, run)
    sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen]
    assert sizes[0] >= 50 and sizes[-1] < 10
    assert jobs.read_sessions(spark, root).where("status = 'closed'").count() == 50


def test_stream_sessions_and_users_equal_batch(spark, log, source, tmp_path):
    auth, done = split(reading(spark, source))
    both = events.activity(auth, done)
    jobs.run_sessions(both, str(tmp_path / "s")).awaitTermination()
    assert sessions_of(jobs.read_sessions(spark, str(tmp_path / "s"))) == session_loop(stream_rows())
    jobs.run_users(both, str(tmp_path / "u")).awaitTermination()
    got = sorted(tuple(r) for r in jobs.read_users(spark, str(tmp_path / "u")).select(
        "user_id", "login_count", "last_login_at", "last_seen_at", "first_seen_at").collect())
    want = sorted(tuple(r) for r in events.user_activity(*split(log)).select(
        "user_id", "login_count", "last_login_at", "last_seen_at", "first_seen_at").collect())
    assert got == want


def top(df):
    return [(r["movie_id"], r["rank_position"]) for r in df.orderBy("rank_position").collect()]


def test_stream_popular(spark, log, source, tmp_path):
    root = str(tmp_path / "p")
    jobs.run_popular(reading(spark, source), root, 5).awaitTermination()
    assert top(jobs.read_popular(spark, root)) == top(events.popular_items(log, 5))
    assert all(spark.read.parquet(f"{root}/popular/{n}").count() <= 5 for n in files.folders(spark, f"{root}/popular"))


def test_popular_writes_changed_items_only(spark, tmp_path):
    """Also where totals fall below an item outside the top, which are then ranked anew."""
    root, done = str(tmp_path / "p"), []
    e = lambda i, item, seconds: (i, 1, item, "s", "finish", BASE, float(seconds))
    parts = [
        [e(i, i, 100 - i) for i in range(20)],
        [e(20, 19, 50), e(21, 3, 1)],  # 19 rises to the top
        [e(22, 0, -90), e(23, 1, -90), e(24, 2, -90), e(25, 3, -90)],  # unchanged ones move up
        [e(26, 30, 1)],
    ]
    for n, rows in enumerate(parts):
        one_by_one(spark, tmp_path, [rows], lambda stream: jobs.run_popular(stream, root, 3))
        done += rows
        assert top(jobs.read_popular(spark, root)) == top(events.popular_items(spark.createDataFrame(done, COLUMNS), 3)), n
        changed = spark.read.parquet(f"{root}/totals/{files.folders(spark, f'{root}/totals')[-1]}").count()
        assert changed == len({r[2] for r in rows}) or changed == 0


ITEMS = [(m, [float(m), 1.0]) for m in range(0, 20, 2)]


def test_embedding_refresh(spark, log, tmp_path):
    root = str(tmp_path / "r")
    items = spark.createDataFrame(ITEMS, "movie_id long, movie_embedding array<float>")
    rows = stream_rows()
    parts = [rows[:100], rows[100:160], rows[160:]]
    seen = one_by_one(spark, tmp_path, parts, lambda stream: jobs.run_embedding_refresh(stream, root, items, limit=15, hours=2))
    assert [p["numInputRows"] for p in seen] == [100, 60, 80]  # a batch reads its own events only
    known, last, want = [], {}, {}
    for part in parts:
        known += part
        newest = max(r[5] for r in part)
        version = f"{newest:%Y-%m-%d-%H-%M}"
        for user in {r[1] for r in part}:
            mine = sorted((r for r in known if r[1] == user), key=lambda r: (r[5], r[0]), reverse=True)[:15]
            mine = [r for r in mine if r[5] >= newest - timedelta(hours=2)]
            weights = [(max(r[6], 30.0), r[2]) for r in mine if r[2] % 2 == 0]
            if weights:
                value = sum(w * m for w, m in weights) / sum(w for w, _ in weights)
                want[(version, user)] = (last.get(user), len(mine), max(r[0] for r in mine), round(value, 4))
            last[user] = version
    found = spark.read.parquet(f"{root}/versions/*/batch_id=*").collect()
    got = {(r["version"], r["user_id"]): (r["previous_version"], r["source_event_count"], r["source_event_max_id"],
                                          round(json.loads(r["embedding"])[0], 4)) for r in found}
    assert got == want
    snapshots = spark.read.parquet(f"{root}/snapshots").collect()
    assert {(r["embedding_version"], r["user_id"]) for r in snapshots} == set(want)
    latest = files.read_json(spark, f"{root}/latest.json", {})
    manifest = files.read_json(spark, f"{root}/versions/{latest['version']}/manifest.json", {})
    assert manifest["version"] == latest["version"] and manifest["source_event_max_id"] <= 239


def test_watch_profile_loop(spark, log):
    from tidewheel.operators import profiles

    items = spark.createDataFrame([(m, [float(m), 1.0]) for m in range(0, 20, 2)], "movie_id long, movie_embedding array<float>")
    as_of = BASE + timedelta(hours=4)
    got = {r["user_id"]: r for r in profiles.watch_profile(log, items, F.lit(as_of), limit=15, hours=2).collect()}
    for user in {r[1] for r in stream_rows()}:
        mine = [r for r in stream_rows() if r[1] == user and r[5] >= as_of - timedelta(hours=2)]
        mine = sorted(mine, key=lambda r: (r[5], r[0]), reverse=True)[:15]
        known = [(max(r[6], 30.0), r[2]) for r in mine if r[2] % 2 == 0]
        if not known:
            assert user not in got
            continue
        want = sum(w * m for w, m in known) / sum(w for w, _ in known)
        assert got[user]["embedding"] == pytest.approx([want, 1.0], rel=1e-6)
        assert got[user]["source_event_count"] == len(mine)
        assert got[user]["source_event_max_id"] == max(r[0] for r in mine)


def test_export(spark, log, source, tmp_path):
    root = str(tmp_path / "x")
    auth, done = split(reading(spark, source))
    auth = auth.withColumn("metadata_json", F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))
    columns = {"auth_events": auth.columns, "user_events": done.columns}
    jobs.run_export(jobs.tagged(auth, done), root, columns).awaitTermination()
    names = files.folders(spark, f"{root}/versions")
    assert len(names) == 4 and len(set(names)) == 4
    ids = [r["event_id"] for k in columns for r in spark.read.parquet(f"{root}/versions/*/{k}").collect()]
    assert sorted(ids) == list(range(240))
    some = spark.read.parquet(f"{root}/versions/*/auth_events").first()
    assert some["metadata_json"] == '{"a":2,"b":1}'
    registry = files.read_json(spark, f"{root}/registry/version.json", {})
    assert [e["version"] for e in registry["versions"]] == names and registry["latest"] == names[-1]


def test_ingest_stream(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, body([login()], [watch()])), (2, body([], [watch(2, "q", time="")]))], "batch_id long, body string")
    df.coalesce(1).write.parquet(path)
    jobs.run_ingest(jobs.file_stream(spark, path, df.schema), root).awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").collect()
    assert sorted((r["batch_ok"], r["kind"]) for r in rows) == [("false", "user"), ("true", "auth"), ("true", "user")] or sorted(
        (r["batch_ok"], r["kind"]) for r in rows
    ) == [(False, "user"), (True, "auth"), (True, "user")]


class CountedState:
    """A value state or handle in memory that notes every call to Spark."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            return self.value if name == "get" else self if name == "getValueState" else None

        return call


def test_a_session_costs_one_read_and_one_write():
    """Timers are touched only when they move; ids and users may be missing."""
    from pyspark.sql import Row

    from tidewheel.streaming.state import SESSION_FIELDS, Sessions

    calls = []
    worker, row = Sessions(timedelta(hours=24)), Row("event_id", "user_id", "event_type", "at", "watch_duration_seconds")
    worker.init(CountedState(calls))
    calls.clear()

    def take(*rows):
        calls.clear()
        [out] = worker.handleInputRows(("s",), iter(rows), None)
        return dict(zip(SESSION_FIELDS, list(out)[1:]))

    state = take(row(4, 7, "finish", 4_000, 2.5), row(3, 7, "login", 3_000, None), row(None, None, "finish", 3_000, None))
    assert calls == ["get", "update"]
    assert (state["opened_by"], state["created_id"], state["first_user"], state["finish_id"]) == (3, None, None, 4)
    assert (state["event_count"], state["total_watch_duration_seconds"], state["login_user"]) == (2, 2.5, 7)
    take(row(5, 7, "logout", 5_000, 0.0))
    assert calls == ["get", "update", "registerTimer"]
    take(row(6, 7, "finish", 6_000, 1.0))
    assert calls == ["get", "update"]  # a watch does not open a closed session
    take(row(8, 7, "login", 8_000, 0.0))
    assert calls == ["get", "update", "deleteTimer"]


def test_recent_watches_take_plain_rows(monkeypatch):
    """One read of a new user's state and none of a list that cannot be there; missing ids come last."""
    from pyspark.sql import Row

    from tidewheel.streaming import state

    calls, row = [], Row("user_id", "event_id", "at", "movie_id", "watch_duration_seconds")
    worker = state.RecentWatches(2)
    worker.batch, worker.recent = CountedState(calls), CountedState(calls)
    monkeypatch.setattr(state.TaskContext, "get", lambda: type("Task", (), {"getLocalProperty": lambda self, name: "3"})())
    found = list(worker.handleInputRows((7,), iter([row(7, None, 20, 5, 1.0), row(7, 1, 10, 6, 2.0), row(7, 2, 20, 2**60 + 1, None)]), None))
    assert calls == ["get", "put", "update"]
    assert [tuple(r) for r in found] == [(7, 2, 20, 2**60 + 1, None, None, 20), (7, None, 20, 5, 1.0, None, 20)]


class Moment:
    """The watermark and the time of a timer, in milliseconds."""

    def __init__(self, now, fired=None):
        self.now, self.fired = now, fired

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired


def test_a_group_of_sessions_costs_one_read_and_one_write():
    """States equal those of single sessions, a group has one timer, and expired sessions alone leave it."""
    from pyspark.sql import Row

    from tidewheel.streaming.state import SESSION_FIELDS, SessionGroups, fold_session

    calls = []
    row = Row("session_id", "event_id", "user_id", "event_type", "at", "watch_duration_seconds")
    worker = SessionGroups(timedelta(milliseconds=10))
    worker.init(CountedState(calls))

    def take(*rows):
        calls.clear()
        return {r[0]: dict(zip(SESSION_FIELDS, list(r)[1:])) for r in worker.handleInputRows((3,), iter(rows), None)}

    def expire(now, fired):
        calls.clear()
        assert list(worker.handleExpiredTimer((3,), Moment(now), Moment(now, fired))) == []

    first = [row(s, i, i, kind, 1000 * i, 1.5) for i, (s, kind) in enumerate([("a", "login"), ("b", "finish"), (None, "login"), ("a", "finish"), ("b", "logout"), ("a", "logout")])]
    got = take(*first)
    assert calls == ["get", "update", "registerTimer"]
    assert got == {s: fold_session(None, [r for r in first if r.session_id == s]) for s in ("a", "b", None)}
    more = [row("c", 9, 7, "login", 9000, 0.0), row("a", 8, 4, "login", 8000, 0.0)]
    again = take(*more)  # b is the first to leave, before and after
    assert calls == ["get", "update"] and set(again) == {"a", "c"}
    assert again["a"] == fold_session(dict(got["a"]), more[1:]) and again["a"]["login_user"] == 4
    take(row("c", 10, 7, "logout", 10000, 0.0))
    assert calls == ["get", "update"]
    expire(15, 14)  # b goes, c waits until 20
    assert calls == ["get", "update", "registerTimer"]
    assert take(row("b", 11, 5, "finish", 15000, 2.0))["b"]["opened_by"] == 11
    assert take(row("a", 12, 4, "finish", 15000, 2.0))["a"]["event_count"] == 2
    expire(30, 20)
    assert calls == ["get", "update"]  # a, b and the missing id are open
    alone = SessionGroups(timedelta(milliseconds=10))
    alone.init(CountedState(calls))
    worker = alone
    take(row("a", 1, 1, "login", 1000, 0.0), row("a", 2, 1, "logout", 2000, 0.0))
    expire(13, 12)
    assert calls == ["get", "clear"]


def test_sessions_are_keyed_by_group(spark, tmp_path):
    """The state has a row per group, so that the calls of a batch are bounded, with the rows of the batch form."""
    many = [(i, i, 1, f"s{i}", "login", BASE + timedelta(seconds=i), 1.0) for i in range(300)]
    root = str(tmp_path / "s")
    seen = one_by_one(spark, tmp_path, [many[:200], many[100:]], lambda stream: jobs.run_sessions(stream, root, groups=7))
    assert [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen][-1] == 7
    rows = jobs.read_sessions(spark, root).collect()
    assert sorted(r["session_id"] for r in rows) == sorted(f"s{i}" for i in range(300))
