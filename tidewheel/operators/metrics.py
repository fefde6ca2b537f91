"""Ranking metrics, request-log summaries, rates, histograms and release checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewheel.session import cut_lineage
from tidewheel.operators.ordering import (
    HOT_ROWS, exact_quantiles, join_per_key, number_rows, running, sliding, with_one_row,
)

# Histogram edges of the serving metrics.
SCORE_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LATENCY_EDGES = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
CANDIDATE_EDGES = [1.0, 10.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
RETURN_EDGES = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 500.0]

CIRCUIT_WINDOW = 50
CIRCUIT_RATE = 0.30


def user_ranking(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Hit and NDCG at ``k`` for each user with at least two scored pairs.

    ``pairs``: user_id, movie_id, label, pred_score.  Gain is the label itself; NDCG is
    0 where the ideal is not positive.  Ties go to the smaller item id.  ``many`` tells
    users with more than ``k`` rows, for whom a hit is not certain.
    """
    by_score = W.partitionBy("user_id").orderBy(F.desc("pred_score"), "movie_id", F.desc("label"))
    by_label = W.partitionBy("user_id").orderBy(F.desc("label"), "movie_id")
    narrow = pairs.select("user_id", "movie_id", "label", "pred_score")
    predicted = (
        narrow.withColumn("r", F.row_number().over(by_score))
        .where(F.col("r") <= k)
        .select("user_id", "movie_id", "label", "r", F.lit("p").alias("side"))
    )
    ideal = (
        narrow.withColumn("r", F.row_number().over(by_label))
        .where(F.col("r") <= k + 1)
        .select("user_id", "movie_id", "label", "r", F.lit("i").alias("side"))
    )
    is_p = F.col("side") == "p"
    is_i = (F.col("side") == "i") & (F.col("r") <= k)
    gain = F.col("label") / F.log2(F.col("r") + 1)
    item = F.col("movie_id")
    grouped = (
        predicted.unionByName(ideal)
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("side") == "i").alias("_rows"),
            F.sum(F.when(is_p, gain)).alias("dcg"),
            F.sum(F.when(is_i, gain)).alias("idcg"),
            F.collect_set(F.when(is_p, item)).alias("_p"),
            F.collect_set(F.when(is_i, item)).alias("_i"),
        )
        .where(F.col("_rows") >= 2)
    )
    return grouped.select(
        "user_id",
        F.when(F.arrays_overlap("_p", "_i"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"),
        (F.col("_rows") > k).alias("many"),
    )


def ranking_metrics(pairs: DataFrame, k: int = 10) -> DataFrame:
    return user_ranking(pairs, k).agg(
        F.coalesce(F.avg("hit_rate"), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"),
        F.count(F.lit(1)).alias("users"),
        F.count_if("many").alias("users_above_k"),
    )


def mse(pairs: DataFrame) -> DataFrame:
    gap = F.col("pred_score") - F.col("label")
    return pairs.agg(F.avg(gap * gap).alias("mse"), F.count(F.lit(1)).alias("samples"))


def latency_summary(
    log: DataFrame, elapsed_seconds: float | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: totals, rates, throughput, mean and exact p50 / p95 / p99 of successes.

    ``log``: ok, latency_ms and, when ``elapsed_seconds`` is not given, ts.
    """
    if elapsed_seconds is None:
        span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
        elapsed = span / F.lit(1e6)
    else:
        elapsed = F.lit(float(elapsed_seconds))
    total = F.count(F.lit(1))
    summary = log.agg(
        total.alias("total_requests"),
        F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.try_divide(F.count_if("ok"), total), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide(F.count_if(~F.col("ok")), total), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.try_divide(total, elapsed), F.lit(0.0)).alias("throughput"),
        F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("latency_avg"),
    )
    probs = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}
    tails = exact_quantiles(log.where("ok"), "latency_ms", probs, (), hot_rows)
    return with_one_row(summary, tails)


def failures_by_type(log: DataFrame) -> DataFrame:
    return log.where(~F.col("ok")).groupBy("error_type").agg(F.count(F.lit(1)).alias("failures"))


def counter(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per label combination: requests by mode and status, fallbacks by reason, clicks by rank."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges below the value: index of the first edge that is not smaller."""
    index = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        index = F.when(value <= F.lit(float(edges[i])), F.lit(i)).otherwise(index)
    return index


def histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts: for each key and edge, rows with a value not above the edge.

    Rows are first counted per bucket; the last edge is +Infinity.
    """
    keys = list(keys)
    bins = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, bucket_of(F.col(value), edges).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_key = bins.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin")
    )
    spread = per_key.select(
        *keys,
        "by_bin",
        F.posexplode(F.array(*[F.lit(float(e)) for e in edges], F.lit(float("inf")))).alias("bin", "le"),
    )
    up_to = F.aggregate(
        F.sequence(F.lit(0), F.col("bin")),
        F.lit(0).cast("long"),
        lambda s, b: s + F.coalesce(F.try_element_at(F.col("by_bin"), b), F.lit(0).cast("long")),
    )
    return spread.select(*keys, "bin", "le", up_to.alias("cumulative"))


def histogram_quantile(cumulative: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile interpolated inside its bucket; the last finite edge above all edges."""
    keys = list(keys)
    buckets = F.sort_array(F.collect_list(F.struct("bin", "le", "cumulative")))
    grouped = cumulative.groupBy(*keys).agg(buckets.alias("b"))
    total = F.element_at("b", -1)["cumulative"]
    rank = F.lit(float(q)) * total
    first = F.filter("b", lambda x: x["cumulative"] >= rank)[0]
    before = F.element_at(F.filter("b", lambda x: x["bin"] < F.col("hit.bin")), -1)
    picked = grouped.where(total > 0).withColumn("hit", first).withColumn(
        "prev", F.when(F.col("hit.bin") > 0, before)
    ).withColumn("rank", rank)
    low = F.coalesce(F.col("prev.le"), F.lit(0.0))
    seen = F.coalesce(F.col("prev.cumulative"), F.lit(0))
    inside = (F.col("rank") - seen) / (F.col("hit.cumulative") - seen)
    value = F.when(F.col("hit.le") == F.lit(float("inf")), low).otherwise(
        low + (F.col("hit.le") - low) * inside
    )
    return picked.select(*keys, value.alias("quantile"))


def _seconds(window: str) -> Column:
    """Length of a window column in seconds."""
    return F.unix_micros(F.col(f"{window}.end")) / 1e6 - F.unix_micros(F.col(f"{window}.start")) / 1e6


def rates(
    log: DataFrame, window: str = "1 minute", slide: str | None = None, keys: Sequence[str] = ("env",)
) -> DataFrame:
    """Per window: requests, requests per second by mode, fallback share, mean candidates."""
    seconds = _seconds("w")
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    model, fallback = F.col("mode") == "model", F.col("mode") == "fallback"
    return (
        log.groupBy(span.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(model).alias("model_requests"),
            F.count_if(fallback).alias("fallback_requests"),
            (F.lit(100.0) * F.try_divide(F.count_if(fallback), F.count(F.lit(1)))).alias("fallback_pct"),
            F.avg("candidates").alias("avg_candidates"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "requests", (F.col("requests") / seconds).alias("rps"),
                (F.col("model_requests") / seconds).alias("model_rps"),
                (F.col("fallback_requests") / seconds).alias("fallback_rps"), "fallback_pct", "avg_candidates")
    )


def click_rates(clicks: DataFrame, window: str = "5 minutes") -> DataFrame:
    return (
        clicks.groupBy(F.window("ts", window).alias("w"), "rank")
        .agg(F.count(F.lit(1)).alias("clicks"))
        .select(F.col("w.start").alias("window_start"), "rank", (F.col("clicks") / _seconds("w")).alias("clicks_per_second"))
    )


def latency_quantiles_by_window(log: DataFrame, q: float = 0.95, window: str = "5 minutes") -> DataFrame:
    """Histogram quantile of model latency per window and environment, in milliseconds."""
    model = log.where(F.col("mode") == "model").withColumn("window_start", F.window("ts", window)["start"])
    keys = ["window_start", "env"]
    found = histogram_quantile(histogram(model, "latency_s", LATENCY_EDGES, keys), q, keys)
    return found.select(*keys, (F.col("quantile") * 1000).alias("latency_ms"))


def release_gate(
    log: DataFrame,
    staging_rate: float = 0.20,
    canary_rate: float = 0.10,
    canary_p95_ms: float = 500.0,
) -> DataFrame:
    """Per environment: fallback share, bucket p95 of model latency, and whether it passes.

    Staging needs a fallback share below ``staging_rate``; canary one below
    ``canary_rate`` and a p95 below ``canary_p95_ms`` (9999 where nothing was measured).
    """
    share = log.groupBy("env").agg(
        F.coalesce(
            F.try_divide(F.count_if(F.col("mode") == "fallback"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("fallback_rate")
    )
    model = log.where(F.col("mode") == "model")
    p95 = histogram_quantile(histogram(model, "latency_s", LATENCY_EDGES, ["env"]), 0.95, ["env"])
    joined = share.join(p95, "env", "left").select(
        "env", "fallback_rate", F.coalesce(F.col("quantile") * 1000, F.lit(9999.0)).alias("p95_ms")
    )
    passed = F.when(F.col("env") == "staging", F.col("fallback_rate") < staging_rate).when(
        F.col("env") == "canary",
        (F.col("fallback_rate") < canary_rate) & (F.col("p95_ms") < canary_p95_ms),
    )
    decision = F.when(passed, "promote").when(~passed, "roll_back")
    return joined.withColumn("passed", passed).withColumn("decision", decision)


def circuit_breaker(
    log: DataFrame,
    width: int = CIRCUIT_WINDOW,
    max_rate: float = CIRCUIT_RATE,
    order: Sequence[str] = ("ts", "event_id"),
    reset: str | None = None,
    hot_rows: int = HOT_ROWS,
    chunk: int = 100_000,
) -> DataFrame:
    """Replay of the breaker: mode after each request of an environment.

    The breaker trips when the last ``width`` requests are present and the share of
    fallbacks exceeds ``max_rate``, and stays tripped until a row whose ``reset``
    column is true, which clears the history before that row is counted.

    Positions, frames and segments are all cut into bounded ranges, so an environment
    that holds most of the log does not end up in one task.
    """
    keys = ["env"]
    if reset:
        log = running(log, ["env"], order, {"segment": F.coalesce(F.col(reset), F.lit(False)).cast("long")}, None, hot_rows)
        keys = ["env", "segment"]
    placed = number_rows(log, keys, order, "position", None, hot_rows)
    used = F.col("fallback_used").cast("long")
    # the frames are read three times: for hot keys, for the first trip and for the replay
    seen = cut_lineage(
        sliding(placed, keys, "position", width, {"_used": F.sum(used), "_rows": F.count(F.lit(1))}, chunk)
    )
    rate = F.col("_used") / F.col("_rows")
    seen = seen.withColumn("rate", rate).withColumn(
        "trips", (F.col("_rows") >= width) & (rate > F.lit(float(max_rate)))
    )
    first = (
        seen.where("trips").groupBy(*keys).agg(F.min("position").alias("_first"))
    )
    after = F.coalesce(F.col("position") >= F.col("_first"), F.lit(False))
    return (
        join_per_key(seen, first, keys, ["position"], "left", hot_rows)
        .withColumn("mode", F.when(after, F.lit("fallback")).otherwise(F.lit("model")))
        .drop("_used", "_rows", "_first")
    )


def breaker_summary(replay: DataFrame, keys: Sequence[str] = ("env",)) -> DataFrame:
    return replay.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("trips").alias("tripping_rows"),
        F.min(F.when(F.col("trips"), F.col("position"))).alias("first_trip"),
        F.count_if(F.col("mode") == "fallback").alias("requests_in_fallback"),
        F.max("rate").alias("max_rate"),
    )
