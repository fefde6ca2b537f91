"""Ratings cleaning, vector intake, request checks and table rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.functions import vectors
from tidewheel.functions.text import whole_number

RATING_COLUMNS = ("user_id", "movie_id", "rating", "timestamp")


def _numbers(df: DataFrame) -> DataFrame:
    """Ids and times as longs, the rating as a double; NULL where the text does not fit."""
    out = []
    for name in df.columns:
        if name == "rating":
            value = F.col(name).cast("string").try_cast("double")
            out.append(F.when(~F.isnan(value), value).alias(name))
        elif name in RATING_COLUMNS:
            out.append(whole_number(F.col(name).cast("string")).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _valid(low: float, high: float) -> Column:
    return (F.col("timestamp") > 0) & F.col("rating").between(low, high)


def clean_ratings(
    raw: DataFrame, low: float = 0.5, high: float = 5.0, drop_invalid: bool = True
) -> DataFrame:
    """Numeric, complete and (if asked) plausible ratings with integer ids and times."""
    df = _numbers(raw).dropna(subset=list(RATING_COLUMNS))
    return df.where(_valid(low, high)) if drop_invalid else df


def clean_stats(raw: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """Rows in, dropped for a missing value, dropped as implausible, and kept."""
    df = _numbers(raw)
    complete = F.lit(True)
    for name in RATING_COLUMNS:
        complete = complete & F.col(name).isNotNull()
    plausible = (F.col("timestamp") > 0) & F.col("rating").between(low, high)
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~complete).alias("dropped_null"),
        F.count_if(complete & ~plausible).alias("dropped_invalid"),
        F.count_if(complete & plausible).alias("rows_out"),
    )


def vector_length(df: DataFrame, vector: str) -> int:
    """The most frequent vector length of a table, the smallest of equally frequent ones."""
    row = df.where(F.col(vector).isNotNull()).agg(F.mode(F.size(vector), True).alias("n")).first()
    if row["n"] is None:
        raise ValueError(f"no usable vector in column {vector}")
    return int(row["n"])


def item_vectors(
    df: DataFrame,
    item: str = "movie_id",
    vector: str = "embedding",
    order: str | None = None,
    dim: int | None = None,
    keep: str = "last",
) -> DataFrame:
    """One vector of length ``dim`` per item.

    ``order`` is the column that says which duplicate came last; without it, ids must
    be unique.  ``dim`` None skips the length test.
    """
    ok = F.col(item).isNotNull() & F.col(vector).isNotNull()
    if dim is not None:
        ok = ok & (F.size(vector) == dim)
    df = df.where(ok)
    if order is None:
        return df.select(F.col(item).alias("movie_id"), F.col(vector).alias("movie_embedding"))
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(F.col(item).alias("movie_id")).agg(
        pick(vector, order).alias("movie_embedding")
    )


def choose_embeddings(profiles: DataFrame) -> DataFrame:
    """Users with the vector a simulated client would use; users without one are left out."""
    picked = vectors.choose("long_term_embedding", "short_term_embedding")
    return profiles.select("user_id", picked.alias("embedding")).where(F.col("embedding").isNotNull())


def choice_counts(profiles: DataFrame) -> DataFrame:
    source = vectors.chosen_source("long_term_embedding", "short_term_embedding")
    return profiles.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("users"))


def watch_duration(duration: Column, key: Column | None = None, seed: int = 42) -> Column:
    """The given seconds if positive, else a whole number from 900 to 7200.

    With ``key`` the stand-in is a function of it and repeats on every run.
    """
    if key is None:
        filler = F.floor(F.uniform(F.lit(900.0), F.lit(7201.0), F.lit(seed)))
    else:
        filler = F.lit(900) + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(6301))
    return F.when(duration > 0, duration).otherwise(filler.cast("double"))


def check_requests(df: DataFrame, dim: int, max_k: int = 500, default_k: int = 10) -> DataFrame:
    """Requests with ``request_k`` filled in and a ``problem`` column, NULL if sound."""
    k = F.coalesce(F.col("request_k"), F.lit(default_k))
    bad_items = F.exists(
        "candidates", lambda c: F.coalesce(F.size(c["movie_embedding"]) != dim, F.lit(True))
    )
    problem = (
        F.when(F.col("request_id").isNull() | F.col("user_id").isNull() | F.col("timestamp").isNull(), "missing_field")
        .when(~k.between(1, max_k), "request_k")
        .when(F.coalesce(F.size("user_embedding") != dim, F.lit(True)), "user_embedding")
        .when(F.coalesce(bad_items, F.lit(True)), "movie_embedding")
    )
    return df.withColumn("request_k", k).withColumn("problem", problem)


# The rules of the state and event tables.
TABLE_RULES: dict[str, dict[str, str]] = {
    "user_events": {
        "event_type": "event_type = 'finish'",
        "watch_duration": "watch_duration_seconds >= 0",
    },
    "auth_events": {"event_type": "event_type IN ('login', 'logout')"},
    "online_sessions": {"status": "status IN ('active', 'closed')"},
    "popular_movies": {"rank_position": "rank_position BETWEEN 1 AND 50"},
    "users": {"login_count": "login_count >= 0"},
    "online_event_stats": {
        "counts": "total_count >= 0 AND abnormal_count >= 0 AND abnormal_count <= total_count"
    },
}


def rule_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows checked and rows that break each rule, one output row per rule.

    A rule that comes out NULL holds, as in SQL CHECK.  All rules are counted in one pass.
    """
    broken = {n: F.coalesce(~F.expr(r), F.lit(False)) for n, r in rules.items()}
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(b).alias(f"_{i}") for i, b in enumerate(broken.values())],
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(broken)]
    )
    return counted.select("rows", F.inline(pairs)).select("rule", "rows", "violations")


def quarantine(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one with the names of the broken rules)."""
    names = F.array_compact(
        F.array(*[F.when(F.coalesce(~F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()])
    )
    marked = df.withColumn("broken_rules", names)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(
        F.size("broken_rules") > 0
    )


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")


def normalise_items(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Explode a recommendation payload (JSON text) to rows with ``movie_id``.

    ``recommendations`` is preferred to ``recommend``; objects give movie_id, else
    item_id, else item; bare values must be whole numbers.
    """
    key = lambda name: F.get_json_object(payload, f"$.{name}")
    listed = F.from_json(F.coalesce(key("recommendations"), key("recommend")), "array<string>")
    rows = df.select("*", F.posexplode(listed).alias("position", "_item"))
    item = F.col("_item")
    field = lambda name: F.get_json_object(item, f"$.{name}")
    is_object = item.startswith("{")
    movie = F.when(is_object, F.coalesce(field("movie_id"), field("item_id"), field("item"))).otherwise(
        whole_number(item).cast("string")
    )
    return (
        rows.withColumn("movie_id", movie)
        .where(is_object | F.col("movie_id").isNotNull())
        .drop("_item")
    )


def sample_profiles(profiles: DataFrame, n: int, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """``n`` users with a vector, drawn by hash: the same users on any file layout."""
    return (
        profiles.where(F.col(vector).isNotNull())
        .orderBy(F.xxhash64("user_id", F.lit(seed)), "user_id")
        .limit(n)
    )


def hash_bucket(user, buckets: int = 128) -> Column:
    return F.pmod(F.xxhash64(F.col(user).cast("string")), F.lit(buckets))
