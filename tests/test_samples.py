"""Profiles, the bootstrap cut, fusion, as-of picks and splits against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import labels, vectors
from tidewheel.operators import profiles, samples, splits, timeline

RATING = "user_id long, movie_id long, rating double, timestamp long, source_key long"


def histories(seed=3):
    rnd = random.Random(seed)
    rows, key = [], 0
    for user, n in [(1, 1), (2, 4), (3, 5), (4, 10), (5, 40), (6, 7), (7, 120)]:
        for _ in range(n):
            key += 1
            rating = 2.0 if user == 6 else rnd.randrange(1, 11) / 2
            rows.append((user, rnd.randrange(30), rating, 1_000_000 + rnd.randrange(60) * 86400, key))
    return rows


VECTORS = {m: [math.sin(m + j) for j in range(4)] for m in range(0, 30, 2)}


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(histories(), RATING).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(list(VECTORS.items()), "movie_id long, movie_embedding array<float>")


def bootstrap(rows):
    """user -> (bootstrap rows, remaining rows), by the written rule."""
    by_user = defaultdict(list)
    for r in rows:
        by_user[r[0]].append(r)
    out = {}
    for user, members in by_user.items():
        members.sort(key=lambda r: (r[3], r[4]))
        n = len(members)
        if n < 5:
            continue
        b = min(max(3, math.floor(n * 0.7)), n - 1)
        if b < 3 or n - b < 1:
            continue
        out[user] = (members[:b], members[b:])
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_bootstrap_cut(ratings, hot_rows):
    got = defaultdict(lambda: ([], []))
    for r in timeline.bootstrap_cut(ratings, hot_rows=hot_rows).orderBy("event_order").collect():
        got[r["user_id"]][0 if r["part"] == "bootstrap" else 1].append(r["source_key"])
    want = {u: ([r[4] for r in b], [r[4] for r in q]) for u, (b, q) in bootstrap(histories()).items()}
    assert dict(got) == want


def profile_loop(rows, last_ts):
    total, weight, used, missing = np.zeros(4), 0.0, 0, 0
    for _, movie, rating, ts, _ in rows:
        if movie not in VECTORS:
            missing += 1
            continue
        w = max(rating - 3.5, 0.0) * math.exp(-math.log(2) / 180 * (last_ts - ts) / 86400)
        if w <= 0:
            continue
        total += w * np.array(VECTORS[movie])
        weight += w
        used += 1
    return (None if weight <= 1e-8 else total / weight), used, missing


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_user_profiles(ratings, items, hot_rows):
    boot = timeline.base_events(timeline.bootstrap_cut(ratings, hot_rows=hot_rows), hot_rows=hot_rows)
    got = {r["user_id"]: r for r in profiles.base_user_profiles(boot, items).collect()}
    want = bootstrap(histories())
    assert set(got) == set(want)
    for user, (rows, _) in want.items():
        last = max(r[3] for r in rows)
        for name, part in (("long_term_embedding", rows), ("short_term_embedding", rows[-10:])):
            vec, used, missing = profile_loop(part, last)
            if vec is None:
                assert got[user][name] is None
            else:
                assert np.allclose(got[user][name], vec, atol=1e-6)
            if name.startswith("long"):
                assert got[user]["num_embedded_bootstrap_interactions"] == used
                assert got[user]["num_missing_embedding_movies"] == missing
    assert got[6]["long_term_embedding"] is None  # only low ratings


def test_user_stats_of_one_value(spark):
    rows = [(1, i, 4.0, 100 + i, i) for i in range(5)]
    got = timeline.user_stats(timeline.bootstrap_cut(spark.createDataFrame(rows, RATING))).first()
    assert got["num_bootstrap_interactions"] == 3 and got["num_remaining_interactions"] == 2
    assert got["std_rating_bootstrap"] == 0.0
    assert got["profile_confidence"] == pytest.approx(math.log(4))


def test_keep_last(spark):
    rows = [(1, 1, 2.0, 10, 1), (1, 1, 5.0, 20, 2), (1, 2, 3.0, 10, 3), (1, 1, 4.0, 20, 1)]
    got = timeline.dedup_keep_last(spark.createDataFrame(rows, RATING)).collect()
    assert sorted((r["movie_id"], r["rating"]) for r in got) == [(1, 5.0), (2, 3.0)]


def test_fuse(spark):
    rows = [
        (1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 2.0], None), (3, None, [3.0, 4.0]), (4, None, None),
        (5, [1.0], [1.0, 2.0]), (6, [], None), (7, [2.0, 2.0], [2.0, 2.0]),
    ]
    df = spark.createDataFrame(
        rows, "user_id long, long_term_embedding array<float>, short_term_embedding array<float>"
    ).withColumn("profile_version", F.lit("v1"))
    got = {r["user_id"]: r["user_embedding"] for r in profiles.fused_users(df).collect()}
    assert set(got) == {1, 2, 3, 6, 7}
    assert np.allclose(got[1], [0.4, 0.6]) and got[2] == [1.0, 2.0] and got[3] == [3.0, 4.0]
    assert got[6] == [] and np.allclose(got[7], [2.0, 2.0])
    counts = {r["source"]: r["users"] for r in profiles.fuse_counts(df).collect()}
    assert counts == {"fused": 2, "long_only": 2, "short_only": 1, "none": 1, "length_mismatch": 1}
    with pytest.raises(ValueError):
        vectors.fuse("a", "b", -1.0, 1.0)
    with pytest.raises(ValueError):
        vectors.fuse("a", "b", 0.0, 0.0)


def test_cosine_zero_rules(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rules = ("null", "model", "zero", "search")
    got = df.select(*[vectors.cosine("a", "b", r).alias(r) for r in rules]).first()
    assert got["null"] is None and got["model"] == 0.0 and got["zero"] == 0.0 and got["search"] == 0.0
    wrong = spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert wrong.select(vectors.cosine("a", "b", "zero").alias("x")).first()["x"] == 0.0


# ---- as-of picks -------------------------------------------------------------------

FILES = {"f1": 5, "f2": 5, "f3": 9, "f4": 0}


def asof_data(seed=11):
    rnd = random.Random(seed)
    events = []
    for name, time in FILES.items():
        for _ in range(60):
            events.append((name, time, 1 if rnd.random() < 0.33 else rnd.randrange(12), rnd.randrange(6)))
    versions = [(u, t) for t in (1, 3, 5, 6, 9, 10) for u in range(14) if rnd.random() < 0.35]
    return events, versions


def picks_by_rule(events, versions, threshold):
    """The picks from two statements: a user's version is the newest not later than the file;
    the cut is the newest version (of anybody) down to which the share of rows with a version
    reaches the threshold, and picks older than the cut are void."""
    times = {t for _, t in versions}
    picks = {}
    for name, time in FILES.items():
        users = [u for f, _, u, _ in events if f == name]
        newest = {u: max(own) for u in set(users) if (own := [t for v, t in versions if v == u and t <= time])}
        share = {t: sum(newest.get(u, -1) >= t for u in users) / max(1, len(users)) for t in times if t <= time}
        cut = max((t for t in share if share[t] >= threshold), default=-1)
        picks |= {(name, u): t for u, t in newest.items() if t >= cut}
    return picks


@pytest.mark.parametrize("threshold", [-0.5, 0.0, 0.2, 0.3, 0.5, 0.8, 1.0, 5.0])
def test_as_of_picks(spark, threshold):
    events, versions = asof_data()
    ev = spark.createDataFrame(events, "file_id string, input_time long, user_id long, movie_id long")
    vs = spark.createDataFrame(versions, "user_id long, version_time long")
    got = samples.as_of_picks(ev, vs, threshold).collect()
    assert {(r["file_id"], r["user_id"]): r["version_time"] for r in got} == picks_by_rule(events, versions, threshold)


def test_no_eligible_version(spark):
    ev = spark.createDataFrame([("f", 1, 1, 1)], "file_id string, input_time long, user_id long, movie_id long")
    vs = spark.createDataFrame([(1, 2)], "user_id long, version_time long")
    assert samples.as_of_picks(ev, vs).count() == 0
    report = samples.coverage_report(ev, vs).first()
    assert (report["file_rows"], report["matched_rows"], report["coverage"]) == (1, 0, 0.0)


def test_version_selection(spark):
    vs = spark.createDataFrame([(1,), (2,), (3,)], "version_time long")
    assert samples.newer_versions(vs, 2).count() == 1 and samples.newer_versions(vs, None).count() == 3
    assert [samples.build_status(*a) for a in ((0, 0), (3, 0), (3, 1))] == [
        "no_input_versions", "already_up_to_date", "ok",
    ]


# ---- labels and splits ---------------------------------------------------------------


def test_labels(spark):
    import hashlib

    df = spark.createDataFrame([(12, 34, 0.5), (1, 2, 5.0), (7, 8, 3.0)], "user_id long, movie_id long, rating double")
    for kind in ("blake2b", "md5"):
        for r in splits.label_offline(df, kind, keep_source=True).collect():
            key = f"{r['user_id']}:{r['movie_id']}".encode()
            if kind == "blake2b":
                u = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") / (2**64 - 1)
            else:
                u = int.from_bytes(hashlib.md5(key).digest()[8:], "little") / (2**64 - 1)
            moved = min(5.0, max(0.5, r["rating"] + (u * 0.2 - 0.1)))
            assert r["label_raw"] == r["rating"] and r["label_jittered"] == pytest.approx(moved)
            assert r["label"] == pytest.approx(1 / (1 + math.exp(-5 * ((moved - 0.5) / 4.5 - 0.5))))
    with pytest.raises(ValueError):
        splits.label_offline(df, "md5", amplitude=0.5)
    with pytest.raises(ValueError):
        labels.label_source(["x"])


def test_online_label_is_monotone(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 1, 600, 10_000)], "label double")
    got = [r["label"] for r in splits.label_online(df).collect()]
    assert got == sorted(got) and got[0] == got[1] == 0.0 and got[3] == got[4] == 1.0


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_split_per_user(ratings, hot_rows):
    rows = splits.split_per_user(ratings, order=("timestamp", "source_key"), hot_rows=hot_rows).collect()
    assert len(rows) == len(histories())
    for r in rows:
        p = (r["seq_order"] - 0.5) / r["user_total"]
        want = "train" if r["user_total"] == 1 or p < 0.7 else "val" if p < 0.7 + 0.1 else "test"
        assert r["dataset_split"] == want


def test_split_by_position_is_a_partition(ratings):
    rows = splits.split_by_position(ratings, order=("user_id", "timestamp", "source_key")).collect()
    n = len(histories())
    assert sorted(r["position"] for r in rows) == list(range(1, n + 1))
    assert sum(r["dataset_split"] == "train" for r in rows) == int(n * 0.7)
    assert sum(r["dataset_split"] != "test" for r in rows) == int(n * (0.7 + 0.1))
    with pytest.raises(ValueError):
        splits.split_by_position(ratings, ratios=(0.5, 0.1, 0.1))


def test_both_dedup_forms_agree(ratings):
    """Splitting narrow rows and joining the wide ones back equals splitting wide rows."""
    wide = splits.dedup_features(ratings)
    direct = splits.split_per_user(wide, order=("timestamp", "movie_id"))
    index = splits.split_per_user(wide.select("user_id", "movie_id", "timestamp"))
    back = splits.rejoin_features(index, wide)
    columns = ["user_id", "movie_id", "timestamp", "rating", "seq_order", "dataset_split"]
    assert sorted(direct.select(*columns).collect()) == sorted(back.select(*columns).collect())


def test_embedded_counts_hold_no_pairs(spark):
    """Users are counted straight from their events, without a table of users and items."""
    from tidewheel.operators import profiles

    rows = [(1, 10, 5.0, 1.0), (1, 10, 4.0, 1.0), (1, 10, 2.0, 1.0), (1, 11, 5.0, 1.0), (2, None, 5.0, 1.0), (None, 10, 5.0, None), (3, 12, 1.0, 1.0)]
    boot = spark.createDataFrame(rows, "user_id long, movie_id long, rating double, time_weight double")
    items = spark.createDataFrame([(10,), (10,), (12,)], "movie_id long")  # an id that repeats counts twice
    found = profiles.embedded_counts(boot, items)
    assert {tuple(r) for r in found.collect()} == {(1, 4, 1), (2, 0, 1), (None, 0, 0), (3, 0, 0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_both_profiles_in_one_pass(spark, ratings, items):
    """Equal to the profiles made one by one, and each vector goes to its user once for both."""
    boot = timeline.base_events(timeline.bootstrap_cut(ratings))
    twice = items.unionByName(items.limit(3))  # ids may repeat
    one = profiles.preference_profile(boot, twice, "long_term_embedding")
    two = profiles.preference_profile(profiles.recent_bootstrap(boot), twice, "short_term_embedding")
    want = {r["user_id"]: tuple(r)[1:] for r in one.join(two, "user_id", "full").collect()}
    both = profiles.preference_profiles(boot, twice)
    got = {r["user_id"]: tuple(r)[1:] for r in both.collect()}
    assert set(got) == set(want) and any(w[1] is None for w in want.values())
    for user, pair in want.items():
        for a, b in zip(got[user], pair):
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-6))
    plan = profiles.base_user_profiles(boot, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
