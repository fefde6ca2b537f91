"""Queries on watch, login and request events, online samples, and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.functions import labels, vectors
from tidewheel.operators.ordering import with_one_row
from tidewheel.operators import (
    cleaning, events, index, ingest, metrics, profiles, retrieval, samples, scoring, sketches,
)
from tidewheel.plans import datasets, sqltext as s
from tidewheel.plans.rating_queries import LABEL, PER_USER, SAMPLES, SPLIT_CASE, exploded
from tidewheel.session import cut_lineage, shared_folder
from tidewheel.sources import tables


def epoch(name: str):
    return F.unix_micros(name)


def constraint_report(spark, folder):
    found = cleaning.rule_report(tables.user_events(spark, folder), cleaning.TABLE_RULES["user_events"])
    auth = cleaning.rule_report(tables.auth_events(spark, folder), cleaning.TABLE_RULES["auth_events"])
    return found.select(F.lit("user_events").alias("checked"), "*").unionAll(
        auth.select(F.lit("auth_events").alias("checked"), "*")
    )


def quarantined_events(spark, folder):
    _, bad = cleaning.quarantine(tables.user_events(spark, folder), cleaning.TABLE_RULES["user_events"])
    return bad.select("event_id", F.array_join("broken_rules", ",").alias("broken_rules"))


def filled_durations(spark, folder):
    """Watch events whose non-positive durations got a stand-in; values are whole tens."""
    found = tables.user_events(spark, folder)
    shifted = F.col("watch_duration_seconds") - 10
    return found.select("event_id", cleaning.watch_duration(shifted, F.col("event_id")).alias("seconds"))


def session_conflicts(spark, folder):
    found = tables.user_events(spark, folder).withColumn(
        "session_id", F.concat_ws("-", "movie_id", F.date_format("event_time", "yyyyMMdd"))
    )
    return events.session_conflicts(found).select("event_id", "session_id", "user_id", "bound_user_id")


def window_stats(spark, folder):
    found = events.window_stats(events.finished(tables.user_events(spark, folder)))
    return found.select(
        epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"),
        "total_count", "abnormal_count",
    )


def window_stats_uneven(spark, folder):
    """Windows of 7 minutes, which restart every hour."""
    found = events.window_stats(tables.user_events(spark, folder), minutes=7)
    return found.select(
        epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"),
        "total_count", "abnormal_count",
    )


def sessions_out(df):
    return df.select(
        "session_id", "user_id", epoch("session_start_time").alias("session_start_time"),
        epoch("session_end_time").alias("session_end_time"), epoch("last_event_time").alias("last_event_time"),
        "status", "event_count",
        F.round("total_watch_duration_seconds", 4).alias("total_watch_duration_seconds"),
    )


def session_stats(spark, folder):
    return sessions_out(events.session_stats(tables.auth_events(spark, folder), tables.user_events(spark, folder)))


def users_out(df):
    return df.select(
        "user_id", "login_count", epoch("last_login_at").alias("last_login_at"),
        epoch("last_seen_at").alias("last_seen_at"), epoch("first_seen_at").alias("first_seen_at"),
        epoch("newest_event_time").alias("newest_event_time"),
    )


def user_activity(spark, folder):
    return users_out(events.user_activity(tables.auth_events(spark, folder), tables.user_events(spark, folder)))


def _popular(spark, folder):
    return events.popular_items(tables.user_events(spark, folder))


def popular_items(spark, folder):
    return _popular(spark, folder).select(
        "movie_id", F.round("score", 4).alias("score"), "watch_count", "rank_position"
    )


def popular_rules(spark, folder):
    return cleaning.rule_report(_popular(spark, folder), cleaning.TABLE_RULES["popular_movies"])


def affected_users(spark, folder):
    return events.affected_users(tables.user_events(spark, folder), 5000)


def events_after(spark, folder):
    return events.after_id(tables.user_events(spark, folder), 500, 200).select("event_id", "user_id", "movie_id")


def _as_of(found):
    return found.agg(F.max("event_time")).scalar()


def recent_events(spark, folder):
    found = tables.user_events(spark, folder)
    return profiles.recent_events(found, 20, _as_of(found), 240).select(
        "user_id", "event_id", "movie_id", F.col("recency").cast("long").alias("recency")
    )


def _watch(spark, folder):
    found = tables.user_events(spark, folder)
    return profiles.watch_profile(found, tables.items(spark, folder), _as_of(found))


def watch_profile(spark, folder):
    return exploded(_watch(spark, folder), "user_id", "embedding")


def watch_profile_sources(spark, folder):
    return _watch(spark, folder).select("user_id", "source_event_count", "source_event_max_id")


def online_label(spark, folder):
    return tables.user_events(spark, folder).select(
        "event_id", F.round(labels.online_label("watch_duration_seconds", 300.0), 9).alias("label")
    )


def file_user_counts(spark, folder):
    found = samples.file_user_counts(tables.input_files(spark, folder))
    return found.select("file_id", "user_id", "user_rows")


def online_samples_asof(spark, folder):
    found = samples.online_samples(
        tables.input_files(spark, folder), tables.vector_versions(spark, folder), tables.items(spark, folder)
    )
    return found.select(
        "file_id", "event_id", "user_id", "movie_id", epoch("version_time").alias("version_time"),
        F.round(vectors.dot("user_embedding", "movie_embedding"), 5).alias("dot"), "label",
    )


def online_samples_early_stop(spark, folder):
    found = samples.as_of_picks(
        tables.input_files(spark, folder), tables.vector_versions(spark, folder), 0.3
    )
    return found.select("file_id", "user_id", "user_rows", epoch("version_time").alias("version_time"))


def coverage_report(spark, folder):
    found = samples.coverage_report(tables.input_files(spark, folder), tables.vector_versions(spark, folder))
    return found.withColumn("coverage", F.round("coverage", 8))


def online_dataset(spark, folder):
    found = datasets.online_dataset(
        tables.input_files(spark, folder), tables.vector_versions(spark, folder), tables.items(spark, folder)
    )
    return found.select("event_id", "user_id", "movie_id", "position", "dataset_split",
                        F.round("label", 9).alias("label"))


def ingest_bodies(spark, folder):
    """Batches of 20 consecutive events as JSON bodies, some with flaws.

    Of every 31 batches one body is no JSON, one has a number for a list, one is empty and
    one holds a number for an event; three more watch a session that they share, each for
    another user.
    """
    found = tables._events(spark, folder)
    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    auth = F.struct(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("-", "user_id", F.date_format("event_time", "yyyyMMdd")).alias("session_id"),
        F.when(F.pmod("event_id", F.lit(97)) == 0, "reset").when(F.col("event_type") == "signup", "login")
        .otherwise("logout").alias("event_type"),
        time.alias("event_time"),
    )
    user = F.struct(
        F.when(F.pmod("event_id", F.lit(89)) == 0, "x").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.get_json_object("props", "$.k").alias("movie_id"),
        F.concat_ws("-", "user_id", F.date_format("event_time", "yyyyMMdd")).alias("session_id"),
        F.when(F.pmod("event_id", F.lit(83)) == 0, "").otherwise(time).alias("event_time"),
        F.col("value").cast("string").alias("watch_duration_seconds"),
    )
    is_auth = F.col("event_type").isin("signup", "error")
    grouped = found.groupBy(F.floor(F.col("event_id") / 20).alias("batch_id")).agg(
        F.collect_list(F.when(is_auth, auth)).alias("auth_events"),
        F.collect_list(F.when(~is_auth, user)).alias("user_events"),
    )
    odd = F.pmod("batch_id", F.lit(31))
    shared = F.struct(
        (F.lit(10**6) + F.col("batch_id")).cast("string").alias("user_id"), F.lit("1").alias("movie_id"),
        F.concat(F.lit("shared-"), F.floor(F.col("batch_id") / 31)).alias("session_id"),
        F.lit("2024-01-01T00:00:00Z").alias("event_time"), F.lit("1").alias("watch_duration_seconds"),
    )
    watched = F.when(odd.isin(11, 12, 13), F.array_append("user_events", shared)).otherwise(F.col("user_events"))
    body = F.to_json(F.struct("auth_events", watched.alias("user_events")))
    return grouped.select(
        "batch_id",
        F.when(odd == 7, "no json {").when(odd == 8, '{"auth_events": 5, "user_events": []}').when(odd == 9, "{}")
        .when(odd == 10, '{"auth_events": [1], "user_events": []}').otherwise(body).alias("body"),
    )


def ingest_validate(spark, folder):
    bodies = ingest_bodies(spark, folder)
    return ingest.batch_report(bodies, ingest.parse_batches(bodies))


def cosine_topk(spark, folder):
    items = tables.items(spark, folder)
    users = items.select(F.col("movie_id").alias("user_id"), F.col("movie_embedding").alias("user_embedding"))
    found = retrieval.top_items(users, items, 10)
    return found.select("user_id", "movie_id", F.round("score", 6).alias("score"), "rank")


def _histories(spark, folder):
    """The ratings, joined once; several jobs read them."""
    return cut_lineage(tables.ratings(spark, folder))


def _users(histories):
    return cut_lineage(histories.select("user_id").distinct())


def _retrieved(spark, folder, histories, k=10):
    items = tables.items(spark, folder)
    _, fused = datasets.offline_inputs(histories, items)
    return retrieval.top_items(fused, items, k)


def user_candidates(spark, folder):
    return _retrieved(spark, folder, _histories(spark, folder)).select("user_id", "movie_id", F.round("score", 5).alias("score"), "rank")


def indexed_candidates(spark, folder):
    """How many users an inverted-file index serves, and whether it finds 95 % of the true 10
    nearest items of the users whose id is divisible by 100, against all items."""
    items = tables.items(spark, folder)
    _, fused = datasets.offline_inputs(_histories(spark, folder), items)
    items = cut_lineage(items)
    found = index.build(items)
    probes, recall = index.measured_probes(fused, items, found, 10, 0.95)
    served = index.search(fused, found, 10, probes)
    return served.agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("user_id") % 100 == 0, F.col("user_id"))).alias("asked"),
        F.lit(recall >= 0.95).alias("enough"),
    )


def request_answers(spark, folder):
    """The whole request path: retrieved candidates as requests, scored by dot product, ranked.

    The best candidate of every seventh user has lost its vector, so those requests fall back.
    """
    items = tables.items(spark, folder)
    _, fused = datasets.offline_inputs(_histories(spark, folder), items)
    found = cut_lineage(retrieval.top_items(fused, items, 10))
    lists = found.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "movie_id"))).alias("found"))
    made = retrieval.with_item_vectors(cut_lineage(lists.join(fused.select("user_id", "user_embedding"), "user_id")), items)
    vector = lambda c: F.when((F.col("user_id") % 7 != 0) | (c["rank"] > 1), c["movie_embedding"])
    candidates = F.transform("candidates", lambda c: F.struct(c["rank"].alias("rank"), c["movie_id"].alias("movie_id"), vector(c).alias("movie_embedding")))
    requests = made.where(F.size("candidates") > 0).select(
        F.col("user_id").alias("request_id"), F.lit(5).alias("request_k"), "user_embedding", F.sort_array(candidates).alias("candidates")
    )
    score = lambda pairs: pairs.withColumn("score", vectors.dot("user_embedding", "movie_embedding"))
    found = scoring.answer_requests(requests, score, scoring.CURATED_IDS[:6])
    return found.select("request_id", "movie_id", "rank", F.round("score", 5).alias("score"), "reason")


def judged_model(spark, folder):
    """A regression on one pair feature, chosen on validation and judged on test rows."""
    from pyspark.ml.regression import LinearRegression

    found = datasets.offline_dataset(tables.ratings(spark, folder), tables.items(spark, folder), jitter="md5", strategy="per_user")
    rows = cut_lineage(
        found.select(
            "user_id", "movie_id", "label", "dataset_split",
            F.coalesce(vectors.cosine_block("user_embedding", "movie_embedding"), F.lit(0.0)).alias("cosine"),
            vectors.dot("user_embedding", "movie_embedding").alias("dot"),
        )
    )
    plain = lambda: LinearRegression(solver="normal", featuresCol="features", labelCol="label")
    judged = scoring.fit_and_judge(rows, {"cosine": (["cosine"], plain()), "dot": (["dot"], plain())}, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    rounded = ("val_mse", "mse", "hit_rate", "ndcg")
    return judged.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in judged.columns])


def versioned_overview(spark, folder):
    """Sketches of three versions of the watch events, merged: rows, and whether the distinct
    counts and the rank of the median are within 2 % of the exact ones."""
    rows = cut_lineage(tables.user_events(spark, folder).select("event_id", "user_id", "movie_id", "watch_duration_seconds"))
    root = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for part in range(3):
        sketches.add_version(rows.where(F.col("event_id") % 3 == part), root, f"v{part}", ["user_id", "movie_id"], ["watch_duration_seconds"])
    told = sketches.overview(spark, root, {"median": 0.5})
    exact = rows.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("movie_id").alias("items"))
    both = cut_lineage(with_one_row(told, exact))
    median = both.select("median_watch_duration_seconds").scalar()
    below = rows.agg(
        F.avg((F.col("watch_duration_seconds") < median).cast("double")).alias("below"),
        F.avg((F.col("watch_duration_seconds") <= median).cast("double")).alias("upto"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.02 * F.col(b)
    return with_one_row(both, below).select(
        "versions", "rows", "least_watch_duration_seconds", "greatest_watch_duration_seconds",
        near("distinct_user_id", "users").alias("users_near"), near("distinct_movie_id", "items").alias("items_near"),
        ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"),
    )


def fallback_candidates(spark, folder):
    histories = _histories(spark, folder)
    found = retrieval.with_popular_fallback(
        _users(histories), cut_lineage(_retrieved(spark, folder, histories)), _popular(spark, folder)
    )
    return found.select("user_id", "movie_id", F.round("score", 4).alias("score"), "rank", "category")


def merge_candidates(spark, folder):
    histories = _histories(spark, folder)
    found = cut_lineage(_retrieved(spark, folder, histories))
    popular = retrieval.with_popular_fallback(
        _users(histories), found.where(F.lit(False)), _popular(spark, folder)
    )
    found = retrieval.merge_candidates(found, popular, 15)
    return found.select("user_id", "movie_id", F.round("score", 4).alias("score"), "source", "rank")


def _requests(spark, folder):
    """One request per user with a fused vector and the user's remaining items as candidates."""
    items = tables.items(spark, folder)
    remaining, users = datasets.offline_inputs(tables.ratings(spark, folder), items)
    once = remaining.select("user_id", "movie_id").distinct()
    return samples.attach_vectors(once, users, items).select(
        F.col("user_id").alias("request_id"), "movie_id", "user_embedding", "movie_embedding",
        F.lit(5).alias("request_k"),
    )


def linear_scores_topk(spark, folder):
    scored = _requests(spark, folder).withColumn("score", scoring.linear_score((0.5, 0.3, -0.2), 0.1))
    return scoring.rank_scores(scored).select("request_id", "movie_id", "rank", "score")


def dense_scores_topk(spark, folder):
    """A one-layer network that only reads the cosine scores like the cosine itself."""
    import numpy as np

    pairs = _requests(spark, folder)
    dim = cleaning.vector_length(tables.items(spark, folder), "movie_embedding")
    weight = np.zeros((1, 2 * dim + 3))
    weight[0, 2 * dim] = 1.0
    scored = scoring.dense_scores(pairs, [(weight, np.zeros(1))])
    return scoring.rank_scores(scored).select("request_id", "movie_id", "rank", "score")


def pair_features(spark, folder):
    found = _requests(spark, folder).select(
        "request_id", "movie_id", vectors.pair_features("user_embedding", "movie_embedding").alias("x")
    )
    return found.select(
        "request_id", "movie_id", F.size("x").alias("columns"),
        F.round(F.element_at("x", -3), 5).alias("cosine"), F.round(F.element_at("x", -2), 5).alias("dot"),
        F.round(F.element_at("x", -1), 5).alias("distance"),
    )


def normalized_popular(spark, folder):
    found = scoring.normalised_popular(_popular(spark, folder))
    return found.select("movie_id", "rank", "score", F.round("candidate_score", 4).alias("candidate_score"))


def enrich_results(spark, folder):
    items = tables.movies(spark, folder).select(F.col("movieId").alias("movie_id"), "title", "genres")
    known = items.where(F.col("movie_id") % 7 != 0)
    return scoring.enrich(_popular(spark, folder).select("movie_id", "rank_position"), known)


def reranked_with_origin(spark, folder):
    """Candidates re-ranked by distance, beside their rank as candidates."""
    before = cut_lineage(_retrieved(spark, folder, _histories(spark, folder))).select(F.col("user_id").alias("request_id"), "movie_id", "rank", "score")
    after = scoring.rank_scores(
        before.select("request_id", "movie_id", (-F.col("score")).alias("score")), k=5
    )
    found = scoring.with_candidate_rank(after, before)
    return found.select("request_id", "movie_id", "rank", "candidate_rank")


def curated_fallback(spark, folder):
    items = tables.movies(spark, folder).select(F.col("movieId").alias("movie_id"))
    return scoring.curated_fallback(items, 30).select("movie_id", "rank", "score")


def _predictions(spark, folder):
    """Ratings with a hashed score in [0, 1]."""
    return tables.ratings(spark, folder).select(
        "user_id", "movie_id", F.col("rating").alias("label"), labels.md5_share("user_id", "movie_id").alias("pred_score")
    )


def ranking_metrics(spark, folder):
    found = metrics.ranking_metrics(_predictions(spark, folder))
    return found.withColumn("hit_rate", F.round("hit_rate", 8)).withColumn("ndcg", F.round("ndcg", 8))


def mse(spark, folder):
    return metrics.mse(_predictions(spark, folder)).withColumn("mse", F.round("mse", 8))


def latency_summary(spark, folder):
    found = metrics.latency_summary(tables.request_log(spark, folder))
    whole = ("total_requests", "successful", "failed")
    return found.select(*[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in found.columns])


def error_breakdown(spark, folder):
    return metrics.failures_by_type(tables.request_log(spark, folder))


def request_counters(spark, folder):
    return metrics.counter(tables.request_log(spark, folder), "env", "mode")


def metric_histogram(spark, folder):
    found = metrics.histogram(tables.request_log(spark, folder), "latency_s", metrics.LATENCY_EDGES, ["mode"])
    return found.select("mode", F.col("bin").cast("int").alias("bin"), "cumulative")


def candidate_histogram(spark, folder):
    log = tables.request_log(spark, folder).withColumn("candidates", F.col("candidates").cast("double"))
    found = metrics.histogram(log, "candidates", metrics.CANDIDATE_EDGES)
    return found.select(F.col("bin").cast("int").alias("bin"), "cumulative")


def rates_by_minute(spark, folder):
    found = metrics.rates(tables.request_log(spark, folder))
    return found.select(
        epoch("window_start").alias("window_start"), "env", "requests",
        *[F.round(c, 8).alias(c) for c in ("rps", "model_rps", "fallback_rps", "fallback_pct", "avg_candidates")],
    )


def rates_sliding(spark, folder):
    found = metrics.rates(tables.request_log(spark, folder), "5 minutes", "1 minute", ())
    return found.select(
        epoch("window_start").alias("window_start"), "requests", F.round("fallback_pct", 8).alias("fallback_pct")
    )


def click_rates(spark, folder):
    log = tables.request_log(spark, folder).where(F.col("ok"))
    clicks = log.select("ts", (F.pmod("candidates", F.lit(10)) + 1).alias("rank"))
    found = metrics.click_rates(clicks)
    return found.select(epoch("window_start").alias("window_start"), "rank", F.round("clicks_per_second", 8).alias("clicks_per_second"))


def latency_by_window(spark, folder):
    found = metrics.latency_quantiles_by_window(tables.request_log(spark, folder), 0.95, "5 minutes")
    return found.select(epoch("window_start").alias("window_start"), "env", F.round("latency_ms", 6).alias("latency_ms"))


def release_gate(spark, folder):
    found = metrics.release_gate(tables.request_log(spark, folder))
    return found.select(
        "env", F.round("fallback_rate", 8).alias("fallback_rate"), F.round("p95_ms", 6).alias("p95_ms"),
        "passed", "decision",
    )


def circuit_breaker(spark, folder):
    found = metrics.circuit_breaker(tables.request_log(spark, folder))
    return found.select("event_id", "env", "position", F.round("rate", 8).alias("rate"), "trips", "mode")


def circuit_breaker_resets(spark, folder):
    log = tables.request_log(spark, folder).withColumn("reloaded", F.col("latency_ms") > 150)
    found = metrics.breaker_summary(metrics.circuit_breaker(log, reset="reloaded"), ("env", "segment"))
    return found.withColumn("max_rate", F.round("max_rate", 8))


WINDOWS = s.USER_EVENTS + """,
placed AS (
  SELECT *, date_trunc('hour', event_time) + to_minutes(((minute(event_time) // {m}) * {m})::BIGINT) AS window_start
  FROM user_events {where})
SELECT epoch_us(window_start) AS window_start, epoch_us(window_start) + {m} * 60000000 AS window_end,
  count(*) AS total_count, count(*) FILTER (watch_duration_seconds < 10) AS abnormal_count
FROM placed GROUP BY window_start"""

SESSIONS = s.ACTIVITY + """,
marks AS (
  SELECT session_id,
    min({'t': event_time, 'i': event_id}) FILTER (event_type IN ('login', 'finish')) AS created,
    max({'t': event_time, 'i': event_id}) FILTER (event_type = 'login') AS last_login,
    max({'t': event_time, 'i': event_id}) FILTER (event_type = 'logout') AS last_logout,
    arg_max(user_id, {'t': event_time, 'i': event_id}) FILTER (event_type = 'login') AS login_user,
    arg_min(user_id, {'t': event_time, 'i': event_id}) FILTER (event_type IN ('login', 'finish')) AS first_user,
    arg_max(event_time, event_id) FILTER (event_type = 'finish') AS last_event_time,
    count(*) FILTER (event_type = 'finish') AS event_count,
    coalesce(sum(watch_duration_seconds) FILTER (event_type = 'finish'), 0) AS watched
  FROM activity GROUP BY session_id),
states AS (
  SELECT *, coalesce(last_logout > created AND coalesce(last_logout > last_login, true), false) AS closed
  FROM marks WHERE created IS NOT NULL)
SELECT session_id, coalesce(login_user, first_user) AS user_id, epoch_us(created.t) AS session_start_time,
  CASE WHEN closed THEN epoch_us(last_logout.t) END AS session_end_time, epoch_us(last_event_time) AS last_event_time,
  CASE WHEN closed THEN 'closed' ELSE 'active' END AS status, event_count,
  round(watched, 4) AS total_watch_duration_seconds
FROM states"""

USERS = s.ACTIVITY + """
SELECT user_id, count(*) FILTER (event_type = 'login') AS login_count,
  epoch_us(arg_max(event_time, event_id) FILTER (event_type = 'login')) AS last_login_at,
  epoch_us(arg_max(event_time, event_id)) AS last_seen_at, epoch_us(min(event_time)) AS first_seen_at,
  epoch_us(max(event_time)) AS newest_event_time
FROM activity GROUP BY user_id"""

POPULAR = """totals AS (
  SELECT movie_id, sum(watch_duration_seconds) AS score, count(*) AS watch_count FROM user_events GROUP BY movie_id),
popular AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, watch_count DESC, movie_id)::INTEGER AS rank_position
  FROM totals QUALIFY rank_position <= 50)"""

RECENT = """recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS recency
  FROM user_events
  WHERE event_time >= (SELECT max(event_time) FROM user_events) - INTERVAL {h} HOUR
  QUALIFY recency <= {n})"""

WATCH = s.USER_EVENTS + ",\n" + RECENT.format(h=720, n=200) + ",\n" + s.VECTORS

RETRIEVED = s.FUSED + """,
norms AS (
  SELECT user_id, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS u FROM fused GROUP BY user_id),
item_norms AS (SELECT movie_id, sqrt(sum(v * v)) AS m FROM item_values GROUP BY movie_id),
scores AS (
  SELECT f.user_id, i.movie_id, sum(f.value::DOUBLE * i.v) / (any_value(u) + 1e-12) / (any_value(m) + 1e-12) AS score
  FROM fused f JOIN item_values i ON i.pos = f.pos JOIN norms USING (user_id)
  JOIN item_norms ON item_norms.movie_id = i.movie_id GROUP BY f.user_id, i.movie_id),
retrieved AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, movie_id)::INTEGER AS rank
  FROM scores QUALIFY rank <= 10)"""

POPULAR_FOR = s.USER_EVENTS + ",\n" + POPULAR

PAIRS = SAMPLES + """,
pairs AS (
  SELECT d.user_id AS request_id, d.movie_id, dot, dot / (sqrt(uu) * sqrt(mm) + 1e-8) AS cosine,
         sqrt(greatest(uu + mm - 2 * dot, 0)) AS distance
  FROM dots d)"""

TOPK = """SELECT request_id, movie_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, movie_id)::INTEGER AS rank,
  round_even(score, 8) AS score FROM (SELECT *, {e} AS score FROM pairs) QUALIFY rank <= 5"""

PREDICTIONS = s.RATINGS + """,
pairs AS (
  SELECT user_id, movie_id, rating AS label,
    md5_number_lower(user_id::VARCHAR || ':' || movie_id::VARCHAR)::DOUBLE / 18446744073709551615.0::DOUBLE AS pred_score
  FROM ratings)"""

PLACED = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred_score DESC, movie_id, label DESC) AS rp,
    row_number() OVER (PARTITION BY user_id ORDER BY label DESC, movie_id) AS ri,
    count(*) OVER (PARTITION BY user_id) AS n FROM pairs),
hits AS (
  SELECT DISTINCT a.user_id FROM placed a JOIN placed b
  ON a.user_id = b.user_id AND a.movie_id = b.movie_id AND a.rp <= 10 AND b.ri <= 10),
per_user AS (
  SELECT user_id, any_value(n) AS n, coalesce(sum(label / log2(rp + 1)) FILTER (rp <= 10), 0) AS dcg,
    coalesce(sum(label / log2(ri + 1)) FILTER (ri <= 10), 0) AS idcg
  FROM placed WHERE n >= 2 GROUP BY user_id)"""

LABELLED = SAMPLES + ",\nlabelled AS (SELECT user_id, movie_id, \"timestamp\", dot, coalesce(cosine, 0) AS cosine, label AS rating FROM samples),\n" + PER_USER.format(
    case=SPLIT_CASE, cols='user_id, movie_id, "timestamp", dot, cosine, rating', order='"timestamp", movie_id, rating', table="labelled")

JUDGED = LABELLED + f""",
rows AS (SELECT user_id, movie_id, dataset_split, {LABEL} AS label, cosine, dot FROM per_user),
fits AS (
  SELECT name, arg, regr_slope(label, x) AS a, regr_intercept(label, x) AS b
  FROM (SELECT 'cosine' AS name, 1 AS arg, label, cosine AS x FROM rows WHERE dataset_split = 'train'
        UNION ALL SELECT 'dot', 2, label, dot FROM rows WHERE dataset_split = 'train') GROUP BY name, arg),
told AS (
  SELECT name, arg, user_id, movie_id, dataset_split, label,
         round(a * (CASE name WHEN 'cosine' THEN cosine ELSE dot END) + b, 9) AS pred_score FROM rows, fits),
vals AS (
  SELECT name, arg, avg((pred_score - label) * (pred_score - label)) AS val_mse FROM told WHERE dataset_split = 'val' GROUP BY name, arg),
best AS (SELECT name, val_mse FROM vals ORDER BY val_mse, arg LIMIT 1),
pairs AS (SELECT user_id, movie_id, label, pred_score FROM told JOIN best USING (name) WHERE dataset_split = 'test'),
""" + PLACED.replace("per_user AS", "per_user_rank AS") + """,
ranked AS (
  SELECT coalesce(avg(CASE WHEN user_id IN (SELECT user_id FROM hits) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS hit_rate,
         coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0) AS ndcg, count(*) AS users FROM per_user_rank)"""
JUDGED_ROW = """SELECT name AS chosen, round(val_mse, 6) AS val_mse, round(mse, 6) AS mse, samples, round(hit_rate, 6) AS hit_rate,
  round(ndcg, 6) AS ndcg, users
FROM best, (SELECT avg((pred_score - label) * (pred_score - label)) AS mse, count(*) AS samples FROM pairs), ranked"""

RANKING = PREDICTIONS + ",\n" + PLACED + """
SELECT round(coalesce(avg(CASE WHEN user_id IN (SELECT user_id FROM hits) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0), 8) AS hit_rate,
  round(coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0), 8) AS ndcg, count(*) AS users,
  count(*) FILTER (n > 10) AS users_above_k FROM per_user"""


def histogram_sql(value: str, edges: list, key: str | None) -> str:
    bins = " UNION ALL ".join(
        f"SELECT {i} AS bin, {e}::DOUBLE AS le" for i, e in enumerate(edges + ["'Infinity'"])
    )
    group = f"{key}, " if key else ""
    return f"""bins AS ({bins}),
histogram AS (
  SELECT {group}bin, le, count(*) FILTER ({value} <= le) AS cumulative
  FROM request_log, bins {{where}} GROUP BY {group}bin, le)"""


def quantile_sql(keys: str, q: float, source: str) -> str:
    return f"""steps AS (
  SELECT *, max(cumulative) OVER (PARTITION BY {keys}) * {q}::DOUBLE AS rank,
    coalesce(lag(cumulative) OVER (PARTITION BY {keys} ORDER BY bin), 0) AS seen,
    coalesce(lag(le) OVER (PARTITION BY {keys} ORDER BY bin), 0) AS low FROM {source}),
hit AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bin) AS r FROM steps WHERE cumulative >= rank),
quantiles AS (
  SELECT {keys}, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - seen) / (cumulative - seen) END AS quantile
  FROM hit WHERE r = 1)"""


EDGES = list(metrics.LATENCY_EDGES)
GATE = (
    s.REQUEST_LOG + ",\n"
    + histogram_sql("latency_s", EDGES, "env").replace("{where}", "WHERE mode = 'model'") + ",\n"
    + quantile_sql("env", 0.95, "histogram")
)
BY_WINDOW = (
    s.REQUEST_LOG + ",\n"
    + histogram_sql("latency_s", EDGES, "time_bucket(INTERVAL '5 minutes', ts) AS w, env")
    .replace("GROUP BY time_bucket(INTERVAL '5 minutes', ts) AS w, env", "GROUP BY w, env")
    .replace("{where}", "WHERE mode = 'model'") + ",\n"
    + quantile_sql("w, env", 0.95, "histogram")
)

BREAKER = s.REQUEST_LOG + """,
marked AS (SELECT *, {reset} AS reloaded FROM request_log),
segmented AS (
  SELECT *, sum(CASE WHEN reloaded THEN 1 ELSE 0 END) OVER (PARTITION BY env ORDER BY ts, event_id) AS segment FROM marked),
framed AS (
  SELECT *, row_number() OVER (PARTITION BY env, segment ORDER BY ts, event_id) AS position,
    avg(CASE WHEN fallback_used THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (
      PARTITION BY env, segment ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS rate
  FROM segmented),
tripping AS (SELECT *, position >= 50 AND rate > 0.3::DOUBLE AS trips FROM framed),
replay AS (
  SELECT *, coalesce(position >= min(position) FILTER (trips) OVER (PARTITION BY env, segment), false) AS open FROM tripping)"""

INGEST = """rows_in AS (
  SELECT event_id // 20 AS batch_id, event_type IN ('signup', 'error') AS is_auth, event_id FROM events),
judged AS (
  SELECT batch_id, is_auth,
    CASE WHEN is_auth THEN event_id % 97 = 0 ELSE event_id % 89 = 0 OR event_id % 83 = 0 END AS bad
  FROM rows_in WHERE batch_id % 31 NOT IN (7, 8, 9, 10)
  UNION ALL SELECT DISTINCT batch_id, true, true FROM rows_in WHERE batch_id % 31 = 10),
flaws AS (SELECT batch_id, count(*) FILTER (bad) AS bad FROM judged GROUP BY batch_id),
sharing AS (
  SELECT batch_id, batch_id % 31 AS odd, bad, batch_id // 31 AS turn FROM flaws WHERE batch_id % 31 IN (11, 12, 13)),
owners AS (SELECT turn, min(odd) FILTER (bad = 0) AS owner FROM sharing GROUP BY turn),
shared AS (
  SELECT batch_id, false AS is_auth, coalesce(owner < odd, false) AS bad FROM sharing JOIN owners USING (turn)),
all_rows AS (SELECT * FROM judged UNION ALL SELECT * FROM shared),
report AS (
  SELECT b.batch_id, count(r.batch_id) AS events, count(*) FILTER (r.bad) AS bad_events,
    CASE b.batch_id % 31 WHEN 7 THEN 'not_json' WHEN 8 THEN 'not_a_list' END AS body_problem
  FROM (SELECT DISTINCT batch_id FROM rows_in) b LEFT JOIN all_rows r ON b.batch_id = r.batch_id GROUP BY 1),
verdicts AS (
  SELECT batch_id, events, bad_events, bad_events = 0 AND batch_id % 31 <> 8 AS accepted, body_problem FROM report)"""

QUERIES = {
    "constraint_report": (constraint_report, s.q(s.USER_EVENTS + ",\n" + s.AUTH_EVENTS, """
SELECT 'user_events' AS checked, 'event_type' AS rule, count(*) AS rows, count(*) FILTER (event_type <> 'finish') AS violations FROM user_events
UNION ALL SELECT 'user_events', 'watch_duration', count(*), count(*) FILTER (watch_duration_seconds < 0) FROM user_events
UNION ALL SELECT 'auth_events', 'event_type', count(*), count(*) FILTER (event_type NOT IN ('login', 'logout')) FROM auth_events""")),
    "quarantined_events": (quarantined_events, s.q(s.USER_EVENTS, """
SELECT event_id, 'event_type' AS broken_rules FROM user_events WHERE event_type <> 'finish'""")),
    "filled_durations": (filled_durations, None),
    "session_conflicts": (session_conflicts, s.q(s.USER_EVENTS + """,
keyed AS (SELECT event_id, user_id, movie_id::VARCHAR || '-' || strftime(event_time, '%Y%m%d') AS session_id FROM user_events),
bound AS (SELECT session_id, arg_min(user_id, event_id) AS bound_user_id FROM keyed GROUP BY session_id)""", """
SELECT event_id, session_id, user_id, bound_user_id FROM keyed JOIN bound USING (session_id) WHERE user_id <> bound_user_id""")),
    "window_stats": (window_stats, "WITH " + WINDOWS.format(m=5, where="WHERE event_type = 'finish'")),
    "window_stats_uneven": (window_stats_uneven, "WITH " + WINDOWS.format(m=7, where="")),
    "session_stats": (session_stats, "WITH " + SESSIONS),
    "user_activity": (user_activity, "WITH " + USERS),
    "popular_items": (popular_items, s.q(POPULAR_FOR, """
SELECT movie_id, round(score, 4) AS score, watch_count, rank_position FROM popular""")),
    "popular_rules": (popular_rules, s.q(POPULAR_FOR, """
SELECT 'rank_position' AS rule, count(*) AS rows, count(*) FILTER (rank_position NOT BETWEEN 1 AND 50) AS violations FROM popular""")),
    "affected_users": (affected_users, "SELECT DISTINCT user_id FROM events WHERE event_id > 5000"),
    "events_after": (events_after, s.q(s.USER_EVENTS, """
SELECT event_id, user_id, movie_id FROM user_events WHERE event_id > 500 ORDER BY event_id LIMIT 200""")),
    "recent_events": (recent_events, s.q(s.USER_EVENTS + ",\n" + RECENT.format(h=240, n=20), """
SELECT user_id, event_id, movie_id, recency FROM recent""")),
    "watch_profile": (watch_profile, s.q(WATCH, """
SELECT user_id, pos::BIGINT AS pos,
  round(round(sum(greatest(watch_duration_seconds, 30) * v) / sum(greatest(watch_duration_seconds, 30)), 12)::FLOAT::DOUBLE + 1.23e-6::DOUBLE, 5) AS value
FROM recent JOIN item_values USING (movie_id) GROUP BY user_id, pos""")),
    "watch_profile_sources": (watch_profile_sources, s.q(WATCH, """
SELECT user_id, count(*) AS source_event_count, max(event_id) AS source_event_max_id FROM recent
GROUP BY user_id HAVING count(*) FILTER (movie_id IN (SELECT vec_id FROM embeddings)) > 0""")),
    "online_label": (online_label, """
SELECT event_id, round(least(1.0::DOUBLE, ln(1 + least(300.0::DOUBLE, greatest(0, value))) / ln(301.0::DOUBLE)), 9) AS label FROM events"""),
    "file_user_counts": (file_user_counts, """
SELECT strftime(ts, '%Y%m%d') AS file_id, user_id, count(*) AS user_rows FROM events GROUP BY 1, 2"""),
    "online_samples_asof": (online_samples_asof, s.q(s.picks(0.8), """
SELECT file_id, event_id, user_id, inputs.movie_id, epoch_us(version_time) AS version_time,
  round(list_dot_product(user_embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS dot, watch_duration_seconds AS label
FROM inputs JOIN picks USING (file_id, user_id) JOIN versions USING (user_id, version_time)
JOIN embeddings ON vec_id = inputs.movie_id""")),
    "online_samples_early_stop": (online_samples_early_stop, s.q(s.picks(0.3), """
SELECT file_id, user_id, user_rows, epoch_us(version_time) AS version_time FROM picks""")),
    "coverage_report": (coverage_report, s.q(s.picks(0.8), """
SELECT file_id, file_rows::BIGINT AS file_rows, coalesce(sum(user_rows), 0)::BIGINT AS matched_rows,
  round(coalesce(sum(user_rows), 0)::DOUBLE / file_rows::DOUBLE, 8) AS coverage,
  count(DISTINCT version_time) AS versions_used
FROM totals LEFT JOIN picks USING (file_id) GROUP BY file_id, file_rows""")),
    "online_dataset": (online_dataset, s.q(s.picks(0.8) + """,
joined AS (
  SELECT event_id, user_id, inputs.movie_id, watch_duration_seconds AS x
  FROM inputs JOIN picks USING (file_id, user_id) JOIN embeddings ON vec_id = inputs.movie_id),
placed AS (SELECT *, row_number() OVER (ORDER BY event_id) AS position, count(*) OVER () AS n FROM joined)""", """
SELECT event_id, user_id, movie_id, position,
  CASE WHEN position <= floor(n * 0.7::DOUBLE) THEN 'train'
       WHEN position <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS dataset_split,
  round(least(1.0::DOUBLE, ln(1 + least(600.0::DOUBLE, greatest(0, x))) / ln(601.0::DOUBLE)), 9) AS label FROM placed""")),
    "ingest_validate": (ingest_validate, s.q(INGEST, """
SELECT * FROM verdicts""")),
    "cosine_topk": (cosine_topk, """
SELECT a.vec_id AS user_id, b.vec_id AS movie_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / ((sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-12)
     * (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-12)), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-12) DESC, b.vec_id)::INTEGER AS rank
FROM embeddings a, embeddings b QUALIFY rank <= 10"""),
    "user_candidates": (user_candidates, s.q(RETRIEVED, """
SELECT user_id, movie_id, round(score, 5) AS score, rank FROM retrieved""")),
    "indexed_candidates": (indexed_candidates, s.q(s.FUSED, """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (user_id % 100 = 0) AS asked, true AS enough FROM fused""")),
    "request_answers": (request_answers, s.q(RETRIEVED, f"""
SELECT user_id AS request_id, movie_id::VARCHAR AS movie_id,
  row_number() OVER (PARTITION BY user_id ORDER BY dot DESC, movie_id)::INTEGER AS rank, round(dot, 5) AS score, 'ranked_by_model' AS reason
FROM (SELECT r.user_id, r.movie_id, r.score * (u + 1e-12) * (m + 1e-12) AS dot
      FROM retrieved r JOIN norms USING (user_id) JOIN item_norms ON item_norms.movie_id = r.movie_id WHERE r.user_id % 7 <> 0)
QUALIFY rank <= 5
UNION ALL
SELECT user_id, id::VARCHAR, place::INTEGER, 0.0::DOUBLE, 'fallback_inference_error'
FROM (SELECT DISTINCT user_id FROM retrieved WHERE user_id % 7 = 0),
     (SELECT unnest({scoring.CURATED_IDS[:5]}) AS id, unnest(range(1, 6)) AS place)""")),
    "versioned_overview": (versioned_overview, s.q(s.USER_EVENTS, """
SELECT 3::BIGINT AS versions, count(*) AS rows, min(watch_duration_seconds) AS least_watch_duration_seconds,
  max(watch_duration_seconds) AS greatest_watch_duration_seconds, true AS users_near, true AS items_near, true AS median_near
FROM user_events""")),
    "judged_model": (judged_model, s.q(JUDGED, JUDGED_ROW)),
    "fallback_candidates": (fallback_candidates, s.q(RETRIEVED + ",\n" + POPULAR_FOR, """
SELECT user_id, movie_id, round(score, 4) AS score, rank, 'embedding' AS category FROM retrieved
UNION ALL
SELECT user_id, movie_id, round(score, 4), rank_position, 'popular' FROM (
  SELECT DISTINCT user_id FROM ratings WHERE user_id NOT IN (SELECT user_id FROM retrieved)), popular
WHERE rank_position <= 20""")),
    "merge_candidates": (merge_candidates, s.q(RETRIEVED + ",\n" + POPULAR_FOR + """,
both_lists AS (
  SELECT user_id, movie_id, score, 1 AS source, rank FROM retrieved
  UNION ALL
  SELECT user_id, movie_id, score, 2, rank_position FROM (SELECT DISTINCT user_id FROM ratings), popular WHERE rank_position <= 20),
once AS (
  SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY source, rank) = 1)""", """
SELECT user_id, movie_id, round(score, 4) AS score, source::INTEGER AS source, place::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, rank, movie_id) AS place FROM once)
WHERE place <= 15""")),
    "linear_scores_topk": (linear_scores_topk, s.q(PAIRS, TOPK.format(
        e="0.5::DOUBLE * cosine + 0.3::DOUBLE * dot - 0.2::DOUBLE * distance + 0.1::DOUBLE"))),
    "dense_scores_topk": (dense_scores_topk, s.q(PAIRS, TOPK.format(e="cosine"))),
    "pair_features": (pair_features, s.q(PAIRS, """
SELECT request_id, movie_id, (SELECT 2 * max(len(embedding)) + 3 FROM embeddings)::INTEGER AS columns,
  round(cosine, 5) AS cosine, round(dot, 5) AS dot, round(distance, 5) AS distance FROM pairs""")),
    "normalized_popular": (normalized_popular, s.q(POPULAR_FOR, """
SELECT movie_id, row_number() OVER (ORDER BY score DESC, movie_id)::INTEGER AS rank,
  round_even(score / (SELECT max(score) FROM popular), 4) AS score, round(score, 4) AS candidate_score
FROM popular QUALIFY rank <= 20""")),
    "enrich_results": (enrich_results, s.q(POPULAR_FOR, """
SELECT movie_id, rank_position,
  CASE WHEN movie_id % 7 <> 0 AND p_partkey IS NOT NULL THEN p_name ELSE 'Movie ' || movie_id END AS title,
  CASE WHEN movie_id % 7 <> 0 AND p_partkey IS NOT NULL THEN p_type || '|' || p_brand || '|' || lower(p_type) ELSE 'Unknown' END AS genres
FROM popular LEFT JOIN part ON p_partkey = movie_id""")),
    "reranked_with_origin": (reranked_with_origin, s.q(RETRIEVED, """
SELECT user_id AS request_id, movie_id, place::INTEGER AS rank, rank AS candidate_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, movie_id) AS place FROM retrieved)
WHERE place <= 5""")),
    "curated_fallback": (curated_fallback, f"""
SELECT p_partkey AS movie_id, row_number() OVER (ORDER BY place NULLS LAST, p_partkey)::INTEGER AS rank, 0.0::DOUBLE AS score
FROM (SELECT p_partkey, list_position({scoring.CURATED_IDS}, p_partkey) AS place FROM part) QUALIFY rank <= 30"""),
    "ranking_metrics": (ranking_metrics, "WITH " + RANKING),
    "mse": (mse, s.q(PREDICTIONS, """
SELECT round(avg((pred_score - label) * (pred_score - label)), 8) AS mse, count(*) AS samples FROM pairs""")),
    "latency_summary": (latency_summary, s.q(s.REQUEST_LOG, """
SELECT count(*) AS total_requests, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
  round((count(*) FILTER (ok))::DOUBLE / count(*)::DOUBLE, 6) AS success_rate,
  round((count(*) FILTER (NOT ok))::DOUBLE / count(*)::DOUBLE, 6) AS error_rate,
  round(count(*)::DOUBLE / ((epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6::DOUBLE), 6) AS throughput,
  round(avg(latency_ms) FILTER (ok), 6) AS latency_avg,
  round(quantile_cont(latency_ms, 0.5) FILTER (ok), 6) AS latency_p50,
  round(quantile_cont(latency_ms, 0.95) FILTER (ok), 6) AS latency_p95,
  round(quantile_cont(latency_ms, 0.99) FILTER (ok), 6) AS latency_p99 FROM request_log""")),
    "error_breakdown": (error_breakdown, s.q(s.REQUEST_LOG, """
SELECT error_type, count(*) AS failures FROM request_log WHERE NOT ok GROUP BY error_type""")),
    "request_counters": (request_counters, s.q(s.REQUEST_LOG, """
SELECT env, mode, count(*) AS total FROM request_log GROUP BY env, mode""")),
    "metric_histogram": (metric_histogram, s.q(
        s.REQUEST_LOG + ",\n" + histogram_sql("latency_s", EDGES, "mode").replace("{where}", ""),
        "SELECT mode, bin, cumulative FROM histogram")),
    "candidate_histogram": (candidate_histogram, s.q(
        s.REQUEST_LOG + ",\n" + histogram_sql("candidates", list(metrics.CANDIDATE_EDGES), None).replace("{where}", ""),
        "SELECT bin, cumulative FROM histogram")),
    "rates_by_minute": (rates_by_minute, s.q(s.REQUEST_LOG, """
SELECT epoch_us(date_trunc('minute', ts)) AS window_start, env, count(*) AS requests, round(count(*) / 60.0::DOUBLE, 8) AS rps,
  round((count(*) FILTER (mode = 'model')) / 60.0::DOUBLE, 8) AS model_rps,
  round((count(*) FILTER (mode = 'fallback')) / 60.0::DOUBLE, 8) AS fallback_rps,
  round(100.0::DOUBLE * ((count(*) FILTER (mode = 'fallback'))::DOUBLE / count(*)::DOUBLE), 8) AS fallback_pct,
  round(avg(candidates), 8) AS avg_candidates FROM request_log GROUP BY 1, 2""")),
    "rates_sliding": (rates_sliding, s.q(s.REQUEST_LOG + """,
spread AS (SELECT *, unnest(range(5)) AS back FROM request_log)""", """
SELECT epoch_us(date_trunc('minute', ts)) - back * 60000000 AS window_start, count(*) AS requests,
  round(100.0::DOUBLE * ((count(*) FILTER (mode = 'fallback'))::DOUBLE / count(*)::DOUBLE), 8) AS fallback_pct
FROM spread GROUP BY 1""")),
    "click_rates": (click_rates, s.q(s.REQUEST_LOG, """
SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS window_start, candidates % 10 + 1 AS rank,
  round(count(*) / 300.0::DOUBLE, 8) AS clicks_per_second FROM request_log WHERE ok GROUP BY 1, 2""")),
    "latency_by_window": (latency_by_window, s.q(BY_WINDOW, """
SELECT epoch_us(w) AS window_start, env, round(quantile * 1000, 6) AS latency_ms FROM quantiles""")),
    "release_gate": (release_gate, s.q(GATE + """,
shares AS (SELECT env, (count(*) FILTER (mode = 'fallback'))::DOUBLE / count(*)::DOUBLE AS fallback_rate FROM request_log GROUP BY env),
judged AS (
  SELECT env, fallback_rate, coalesce(quantile * 1000, 9999) AS p95_ms FROM shares LEFT JOIN quantiles USING (env)),
decided AS (
  SELECT *, CASE WHEN env = 'staging' THEN fallback_rate < 0.2
                 WHEN env = 'canary' THEN fallback_rate < 0.1 AND p95_ms < 500 END AS passed FROM judged)""", """
SELECT env, round(fallback_rate, 8) AS fallback_rate, round(p95_ms, 6) AS p95_ms, passed,
  CASE WHEN passed THEN 'promote' WHEN NOT passed THEN 'roll_back' END AS decision FROM decided""")),
    "circuit_breaker": (circuit_breaker, s.q(BREAKER.format(reset="false"), """
SELECT event_id, env, position, round(rate, 8) AS rate, trips, CASE WHEN open THEN 'fallback' ELSE 'model' END AS mode FROM replay""")),
    "circuit_breaker_resets": (circuit_breaker_resets, s.q(BREAKER.format(reset="latency_ms > 150"), """
SELECT env, segment::BIGINT AS segment, count(*) AS requests, count(*) FILTER (trips) AS tripping_rows,
  min(position) FILTER (trips) AS first_trip, count(*) FILTER (open) AS requests_in_fallback, round(max(rate), 8) AS max_rate
FROM replay GROUP BY env, segment""")),
}
