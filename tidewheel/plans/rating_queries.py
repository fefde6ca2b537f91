"""Queries on rating histories: cleaning, profiles, offline samples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewheel.functions import vectors
from tidewheel.operators import cleaning, profiles, profiling, samples, splits, timeline
from tidewheel.plans import datasets, sqltext as s
from tidewheel.session import cut_lineage
from tidewheel.sources import tables


def exploded(df: DataFrame, key: str, vector: str, digits: int = 5) -> DataFrame:
    """A vector column as rows (key, pos, value).

    The mean of two short decimals can lie exactly between two rounded values, where the
    last bit of a sum decides; a small shift moves such values off the tie.
    """
    return df.select(key, F.posexplode(vector).alias("pos", "value")).select(
        key, F.col("pos").cast("long").alias("pos"), F.round(F.col("value").cast("double") + 1.23e-6, digits).alias("value")
    )


def clean_ratings(spark, folder):
    return cleaning.clean_ratings(tables.raw_ratings(spark, folder))


def clean_stats(spark, folder):
    return cleaning.clean_stats(tables.raw_ratings(spark, folder))


def user_timeline(spark, folder):
    return timeline.user_timeline(tables.ratings(spark, folder))


def dedup_keep_last(spark, folder):
    return timeline.dedup_keep_last(tables.ratings(spark, folder))


def _cut(spark, folder):
    return timeline.bootstrap_cut(tables.ratings(spark, folder))


def _boot(spark, folder):
    return timeline.base_events(cut_lineage(_cut(spark, folder)))  # read by totals and rows


def bootstrap_split(spark, folder):
    return _cut(spark, folder).select(
        "user_id", "movie_id", "rating", "timestamp", "event_order", "n", "boot_n", "part", "future_event_order"
    )


def bootstrap_split_dedup(spark, folder):
    cut = timeline.bootstrap_cut(tables.ratings(spark, folder), keep_last=True)
    return cut.select("user_id", "movie_id", "timestamp", "event_order", "n", "boot_n", "part")


def time_decay(spark, folder):
    return _boot(spark, folder).select(
        "user_id", "movie_id", "timestamp", F.col("event_order").cast("long").alias("event_order"),
        F.round("time_weight", 9).alias("time_weight"),
    )


def rating_centered(spark, folder):
    return _boot(spark, folder).select(
        "user_id", "movie_id", "rating", F.round("rating_centered", 9).alias("rating_centered"), "is_positive"
    )


def user_stats(spark, folder):
    stats = timeline.user_stats(_cut(spark, folder))
    for c in ("avg_rating_bootstrap", "std_rating_bootstrap", "activity_span_days", "profile_confidence"):
        stats = stats.withColumn(c, F.round(c, 8))
    return stats


def long_profile(spark, folder):
    found = profiles.preference_profile(_boot(spark, folder), tables.items(spark, folder))
    return exploded(found, "user_id", "long_term_embedding")


def short_profile(spark, folder):
    boot = profiles.recent_bootstrap(_boot(spark, folder))
    found = profiles.preference_profile(boot, tables.items(spark, folder), "short_term_embedding")
    return exploded(found, "user_id", "short_term_embedding")


def _profiles(spark, folder):
    base = datasets.base_tables(tables.ratings(spark, folder), tables.items(spark, folder))
    return base["base_user_profiles"]


def user_profiles(spark, folder):
    return _profiles(spark, folder).select(
        "user_id",
        F.col("long_term_embedding").isNotNull().alias("has_long"),
        F.col("short_term_embedding").isNotNull().alias("has_short"),
        F.round("rating_bias", 8).alias("rating_bias"),
        "activity_level",
        "profile_version",
    )


def fused_profile(spark, folder):
    return exploded(profiles.fused_users(_profiles(spark, folder)), "user_id", "user_embedding")


def fuse_report(spark, folder):
    return profiles.fuse_counts(_profiles(spark, folder))


def embedding_choice(spark, folder):
    return cleaning.choice_counts(_profiles(spark, folder))


def missing_vectors(spark, folder):
    return profiles.embedded_counts(_boot(spark, folder), tables.items(spark, folder))


def build_counters(spark, folder):
    ratings = tables.ratings(spark, folder)
    cut = cut_lineage(timeline.bootstrap_cut(ratings))
    found = profiles.base_user_profiles(timeline.base_events(cut), tables.items(spark, folder))
    return timeline.build_counters(ratings, cut, found)


def hash_sample(spark, folder):
    users = profiles.fused_users(_profiles(spark, folder))
    return cleaning.sample_profiles(users, 100, "user_embedding").select("user_id")


def offline_samples(spark, folder):
    found = datasets.offline_samples(tables.ratings(spark, folder), tables.items(spark, folder))
    return found.select(
        "user_id", "movie_id", "timestamp", F.col("future_event_order").cast("long").alias("future_event_order"),
        "label", F.round(vectors.dot("user_embedding", "movie_embedding"), 5).alias("dot"), "profile_version",
    )


def offline_dataset(spark, folder):
    """The whole way from ratings to labelled and split samples."""
    found = datasets.offline_dataset(
        tables.ratings(spark, folder), tables.items(spark, folder), jitter="md5", strategy="per_user"
    )
    return found.select(
        "user_id", "movie_id", "timestamp", "dataset_split", F.round("label", 9).alias("label"),
        F.round(vectors.dot("user_embedding", "movie_embedding"), 5).alias("dot"),
    )


def _narrow(spark, folder):
    return tables.ratings(spark, folder).select("user_id", "movie_id", "rating", "timestamp")


def offline_label_md5(spark, folder):
    return splits.label_offline(_narrow(spark, folder), "md5").withColumn("label", F.round("label", 9))


def offline_label_blake2b(spark, folder):
    return splits.label_offline(_narrow(spark, folder), "blake2b").withColumn("label", F.round("label", 9))


def split_per_user(spark, folder):
    return splits.split_per_user(_narrow(spark, folder).drop("rating"))


def split_by_position(spark, folder):
    return splits.split_by_position(_narrow(spark, folder).drop("rating"))


def split_counts(spark, folder):
    ratings = _narrow(spark, folder).drop("rating")
    counted = lambda df, name: splits.split_counts(df).select(F.lit(name).alias("strategy"), "*")
    return counted(splits.split_per_user(ratings), "per_user").unionAll(
        counted(splits.split_by_position(ratings), "by_position")
    )


def feature_dedup(spark, folder):
    return splits.dedup_features(tables.ratings(spark, folder), tie=("source_key", "rating"))


def split_rejoin(spark, folder):
    ratings = tables.ratings(spark, folder)
    wide = splits.dedup_features(ratings, tie=("source_key", "rating"))
    index = splits.split_per_user(ratings.select("user_id", "movie_id", "timestamp"))
    return splits.rejoin_features(index, wide).select(
        "user_id", "movie_id", "timestamp", "seq_order", "dataset_split", "rating", "source_key"
    )


def rejoin_losses(spark, folder):
    ratings = tables.ratings(spark, folder)
    keyed = ratings.withColumn("movie_id", F.when(F.col("movie_id") % 10 != 0, F.col("movie_id")))
    index = splits.split_per_user(keyed.select("user_id", "movie_id", "timestamp"))
    wide = splits.dedup_features(keyed, tie=("source_key", "rating"))
    return splits.lost_on_rejoin(index, splits.rejoin_features(index, wide))


def label_audit(spark, folder):
    labelled = splits.label_offline(_narrow(spark, folder), "md5")
    audit = splits.label_audit(splits.split_per_user(labelled, order=("timestamp", "movie_id", "rating")))
    for c in ("min_label", "max_label", "avg_label", "share"):
        audit = audit.withColumn(c, F.round(c, 8))
    return audit


def dataset_overview(spark, folder):
    return profiling.overview(tables.ratings(spark, folder), exact=True)


def overview_approx(spark, folder):
    return profiling.overview(tables.ratings(spark, folder))


def activity_stats(spark, folder):
    ratings = tables.ratings(spark, folder)
    both = None
    for key in ("user_id", "movie_id"):
        one = profiling.activity(ratings, key).select(F.lit(key).alias("entity"), "*")
        both = one if both is None else both.unionAll(one)
    return both.withColumn("avg_events", F.round("avg_events", 8)).withColumn(
        "std_events", F.round("std_events", 8)
    )


def label_stats(spark, folder):
    found = profiling.label_stats(splits.label_offline(_narrow(spark, folder), "md5"))
    return found.select(*[F.round(c, 8).alias(c) if c != "rows" else F.col(c) for c in found.columns])


def label_histogram(spark, folder):
    return profiling.label_histogram(tables.ratings(spark, folder), "rating")


def _pairs(spark, folder):
    return datasets.offline_samples(tables.ratings(spark, folder), tables.items(spark, folder))


def similarity_histogram(spark, folder):
    found = profiling.similarity_histogram(_pairs(spark, folder), fraction=None)
    return found.select(
        "sim_bin", "sample_count", F.round("avg_label", 8).alias("avg_label"), "min_label", "max_label",
        F.round("avg_cosine_sim", 6).alias("avg_cosine_sim"),
    )


def similarity_histogram_sampled(spark, folder):
    return profiling.similarity_histogram(_pairs(spark, folder), fraction=0.02)


def cosine_stats(spark, folder):
    found = profiling.cosine_stats(_pairs(spark, folder), fraction=None)
    return found.select(*[F.round(c, 6).alias(c) if c != "sample_count" else F.col(c) for c in found.columns])


def vector_shape(spark, folder):
    return profiling.vector_shape(_pairs(spark, folder), ["user_embedding", "movie_embedding"])


def time_extremes(spark, folder):
    ratings = tables.ratings(spark, folder).select("timestamp", "user_id", "movie_id")
    return profiling.time_extremes(ratings, ["timestamp", "user_id", "movie_id"])


EXPLODED = "SELECT user_id, pos::BIGINT AS pos, round({v}::DOUBLE + 1.23e-6::DOUBLE, 5) AS value FROM {t}"

SAMPLES = s.FUSED + """,
dots AS (
  SELECT f.user_id, i.movie_id, sum(f.value::DOUBLE * i.v) AS dot,
         sum(f.value::DOUBLE * f.value::DOUBLE) AS uu, sum(i.v * i.v) AS mm
  FROM (SELECT DISTINCT user_id, movie_id FROM cut WHERE part = 'remaining') p
  JOIN fused f ON f.user_id = p.user_id JOIN item_values i ON i.movie_id = p.movie_id AND i.pos = f.pos
  GROUP BY ALL),
samples AS (
  SELECT cut.user_id, cut.movie_id, "timestamp", future_event_order, rating AS label, dot,
         dot / nullif(sqrt(uu) * sqrt(mm), 0) AS cosine
  FROM cut JOIN dots USING (user_id, movie_id) WHERE part = 'remaining')"""

LABEL = """1.0::DOUBLE / (1.0::DOUBLE + exp(-5.0::DOUBLE * ((least(5.0::DOUBLE, greatest(0.5::DOUBLE, rating +
  (md5_number_lower(user_id::VARCHAR || ':' || movie_id::VARCHAR)::DOUBLE / 18446744073709551615.0::DOUBLE
   * 0.2::DOUBLE - 0.1::DOUBLE))) - 0.5::DOUBLE) / 4.5::DOUBLE - 0.5::DOUBLE)))"""

SPLIT_CASE = """CASE WHEN user_total = 1 THEN 'train'
  WHEN (seq_order - 0.5::DOUBLE) / user_total::DOUBLE < 0.7::DOUBLE THEN 'train'
  WHEN (seq_order - 0.5::DOUBLE) / user_total::DOUBLE < 0.7::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"""

PER_USER = """per_user AS (
  SELECT *, {case} AS dataset_split FROM (
    SELECT {cols}, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS seq_order,
           count(*) OVER (PARTITION BY user_id) AS user_total FROM {table}))"""

SPLIT_SQL = s.RATINGS + ",\n" + PER_USER.format(
    case=SPLIT_CASE, cols='user_id, movie_id, "timestamp"', order='"timestamp", movie_id', table="ratings"
)

POSITION_SQL = s.RATINGS + """,
placed AS (
  SELECT user_id, movie_id, "timestamp", row_number() OVER (ORDER BY user_id, "timestamp", movie_id) AS position,
         count(*) OVER () AS n FROM ratings),
by_position AS (
  SELECT user_id, movie_id, "timestamp", position,
         CASE WHEN position <= floor(n * 0.7::DOUBLE) THEN 'train'
              WHEN position <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS dataset_split
  FROM placed)"""

COUNTS = """SELECT '{n}' AS strategy, count(*) FILTER (dataset_split = 'train') AS train_rows,
  count(*) FILTER (dataset_split = 'val') AS val_rows, count(*) FILTER (dataset_split = 'test') AS test_rows,
  count(*) AS rows FROM {n}"""

DEDUP = """deduped AS (
  SELECT user_id, movie_id, rating, "timestamp", source_key FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, movie_id, "timestamp" ORDER BY source_key, rating) AS r
    FROM ratings) WHERE r = 1)"""

ACTIVITY = """SELECT '{k}' AS entity, count(*) AS entities, min(c) AS min_events, max(c) AS max_events,
  round(avg(c), 8) AS avg_events, quantile_cont(c, 0.5) AS p50_events, quantile_cont(c, 0.9) AS p90_events,
  quantile_cont(c, 0.99) AS p99_events, round(coalesce(stddev_samp(c), 0), 8) AS std_events
  FROM (SELECT count(*) AS c FROM ratings GROUP BY {k})"""

KEEP_LAST = s.RATINGS + """,
last_rows AS (
  SELECT user_id, movie_id, rating, "timestamp", source_key FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, movie_id
      ORDER BY "timestamp" DESC, source_key DESC, rating DESC) AS r FROM ratings) WHERE r = 1)"""

DEDUP_CUT = KEEP_LAST + """,
timeline AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", source_key, movie_id, rating) AS event_order,
         count(*) OVER (PARTITION BY user_id) AS n FROM last_rows),
bounded AS (SELECT *, least(greatest(3, floor(n * 0.7::DOUBLE)::BIGINT), n - 1) AS boot_n FROM timeline)"""

FUSE_CASES = s.PROFILES + """,
users AS (SELECT DISTINCT user_id FROM boot),
flags AS (
  SELECT user_id, user_id IN (SELECT user_id FROM long_v) AS l, user_id IN (SELECT user_id FROM short_v) AS s FROM users)"""

QUANTILES = ", ".join(
    f"round(quantile_cont({{v}}, {p}), {{d}}) AS {n}"
    for n, p in (("p01", 0.01), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
)

QUERIES = {
    "clean_ratings": (clean_ratings, s.q(s.RAW_RATINGS, """
SELECT user_id::BIGINT AS user_id, movie_id::BIGINT AS movie_id, rating, "timestamp"::BIGINT AS "timestamp", source_key
FROM numbers WHERE complete AND "timestamp" > 0 AND rating BETWEEN 0.5 AND 5.0""")),
    "clean_stats": (clean_stats, s.q(s.RAW_RATINGS, """
SELECT count(*) AS rows_in, count(*) FILTER (NOT complete) AS dropped_null,
  count(*) FILTER (complete AND NOT ("timestamp" > 0 AND rating BETWEEN 0.5 AND 5.0)) AS dropped_invalid,
  count(*) FILTER (complete AND "timestamp" > 0 AND rating BETWEEN 0.5 AND 5.0) AS rows_out FROM numbers""")),
    "user_timeline": (user_timeline, s.q(s.TIMELINE, "SELECT * FROM timeline")),
    "dedup_keep_last": (dedup_keep_last, s.q(KEEP_LAST, "SELECT * FROM last_rows")),
    "bootstrap_split": (bootstrap_split, s.q(s.CUT, """
SELECT user_id, movie_id, rating, "timestamp", event_order, n, boot_n, part, future_event_order FROM cut""")),
    "bootstrap_split_dedup": (bootstrap_split_dedup, s.q(DEDUP_CUT, """
SELECT user_id, movie_id, "timestamp", event_order, n, boot_n,
  CASE WHEN event_order <= boot_n THEN 'bootstrap' ELSE 'remaining' END AS part
FROM bounded WHERE n >= 5 AND boot_n >= 3 AND n - boot_n >= 1""")),
    "time_decay": (time_decay, s.q(s.BOOT, """
SELECT user_id, movie_id, "timestamp", event_order, round(time_weight, 9) AS time_weight FROM boot""")),
    "rating_centered": (rating_centered, s.q(s.BOOT, """
SELECT user_id, movie_id, rating, round(rating_centered, 9) AS rating_centered, is_positive FROM boot""")),
    "user_stats": (user_stats, s.q(s.CUT, """
SELECT user_id, count(*)::INTEGER AS num_total_interactions,
  (count(*) FILTER (part = 'bootstrap'))::INTEGER AS num_bootstrap_interactions,
  (count(*) FILTER (part = 'remaining'))::INTEGER AS num_remaining_interactions,
  min("timestamp") AS first_timestamp, max("timestamp") FILTER (part = 'bootstrap') AS last_bootstrap_timestamp,
  max("timestamp") AS last_total_timestamp,
  round(avg(rating) FILTER (part = 'bootstrap'), 8) AS avg_rating_bootstrap,
  round(coalesce(stddev_samp(rating) FILTER (part = 'bootstrap'), 0), 8) AS std_rating_bootstrap,
  round((max("timestamp") - min("timestamp"))::DOUBLE / 86400.0::DOUBLE, 8) AS activity_span_days,
  round(ln(1.0::DOUBLE + count(*) FILTER (part = 'bootstrap')), 8) AS profile_confidence
FROM cut GROUP BY user_id""")),
    "long_profile": (long_profile, s.q(s.PROFILES, EXPLODED.format(v="value", t="long_v"))),
    "short_profile": (short_profile, s.q(s.PROFILES, EXPLODED.format(v="value", t="short_v"))),
    "user_profiles": (user_profiles, s.q(FUSE_CASES, """
SELECT flags.user_id, l AS has_long, s AS has_short, rating_bias, activity_level, 'v1' AS profile_version FROM flags
JOIN (SELECT user_id, round(avg(rating), 8) AS rating_bias, count(*)::DOUBLE AS activity_level FROM boot GROUP BY user_id)
USING (user_id)""")),
    "fused_profile": (fused_profile, s.q(s.FUSED, EXPLODED.format(v="value", t="fused"))),
    "fuse_report": (fuse_report, s.q(FUSE_CASES, """
SELECT CASE WHEN l AND s THEN 'fused' WHEN l THEN 'long_only' WHEN s THEN 'short_only' ELSE 'none' END AS source,
  count(*) AS users FROM flags GROUP BY 1""")),
    "embedding_choice": (embedding_choice, s.q(FUSE_CASES, """
SELECT CASE WHEN l THEN 'long_term' WHEN s THEN 'short_term' ELSE 'none' END AS source, count(*) AS users
FROM flags GROUP BY 1""")),
    "missing_vectors": (missing_vectors, s.q(s.BOOT, """
SELECT user_id, (count(*) FILTER (vec_id IS NOT NULL AND rating > 3.5))::INTEGER AS num_embedded_bootstrap_interactions,
  (count(*) FILTER (vec_id IS NULL))::INTEGER AS num_missing_embedding_movies
FROM boot LEFT JOIN embeddings ON vec_id = movie_id GROUP BY user_id""")),
    "build_counters": (build_counters, s.q(s.PROFILES, """
SELECT (SELECT count(DISTINCT user_id) FROM ratings) AS users_seen,
  (SELECT count(DISTINCT user_id) FROM cut) AS users_kept,
  (SELECT count(DISTINCT user_id) FROM ratings) - (SELECT count(DISTINCT user_id) FROM cut) AS users_skipped,
  (SELECT count(*) FROM cut WHERE part = 'bootstrap') AS bootstrap_events,
  (SELECT count(*) FROM cut WHERE part = 'remaining') AS remaining_events,
  (SELECT count(DISTINCT user_id) FROM long_v) AS users_with_long_vector,
  (SELECT count(DISTINCT user_id) FROM short_v) AS users_with_short_vector""")),
    "hash_sample": (hash_sample, None),
    "offline_samples": (offline_samples, s.q(SAMPLES, """
SELECT user_id, movie_id, "timestamp", future_event_order, label, round(dot, 5) AS dot, 'v1' AS profile_version
FROM samples""")),
    "offline_dataset": (offline_dataset, s.q(
        SAMPLES + ",\nlabelled AS (SELECT user_id, movie_id, \"timestamp\", dot, label AS rating FROM samples),\n"
        + PER_USER.format(
            case=SPLIT_CASE, cols='user_id, movie_id, "timestamp", dot, rating',
            order='"timestamp", movie_id, rating', table="labelled"),
        f'SELECT user_id, movie_id, "timestamp", dataset_split, round({LABEL}, 9) AS label, round(dot, 5) AS dot FROM per_user')),
    "offline_label_md5": (offline_label_md5, s.q(
        s.RATINGS, f'SELECT user_id, movie_id, rating, "timestamp", round({LABEL}, 9) AS label FROM ratings')),
    "offline_label_blake2b": (offline_label_blake2b, None),
    "split_per_user": (split_per_user, s.q(SPLIT_SQL, "SELECT * FROM per_user")),
    "split_by_position": (split_by_position, s.q(POSITION_SQL, "SELECT * FROM by_position")),
    "split_counts": (split_counts, s.q(
        SPLIT_SQL + "," + POSITION_SQL[len(s.RATINGS) + 1:],
        COUNTS.format(n="per_user") + " UNION ALL " + COUNTS.format(n="by_position"))),
    "feature_dedup": (feature_dedup, s.q(s.RATINGS + ",\n" + DEDUP, "SELECT * FROM deduped")),
    "split_rejoin": (split_rejoin, s.q(SPLIT_SQL + ",\n" + DEDUP, """
SELECT user_id, movie_id, "timestamp", seq_order, dataset_split, rating, source_key
FROM per_user JOIN deduped USING (user_id, movie_id, "timestamp")""")),
    "rejoin_losses": (rejoin_losses, s.q(s.RATINGS, """
SELECT count(*) AS index_rows, count(*) FILTER (movie_id % 10 <> 0) AS joined_rows,
  count(*) FILTER (movie_id % 10 = 0) AS lost_rows FROM ratings""")),
    "label_audit": (label_audit, s.q(
        s.RATINGS + ",\n" + PER_USER.format(
            case=SPLIT_CASE, cols='user_id, movie_id, "timestamp", rating',
            order='"timestamp", movie_id, rating', table="ratings"),
        f"""SELECT dataset_split, count(*) AS rows, count(DISTINCT user_id) AS users,
  round(min({LABEL}), 8) AS min_label, round(max({LABEL}), 8) AS max_label, round(avg({LABEL}), 8) AS avg_label,
  count(*) FILTER ({LABEL} <= 0 OR {LABEL} > 1) AS out_of_range,
  round(count(*)::DOUBLE / (SELECT count(*) FROM ratings)::DOUBLE, 8) AS share FROM per_user GROUP BY dataset_split""")),
    "dataset_overview": (dataset_overview, s.q(s.RATINGS, """
SELECT count(*) AS total_rows, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp,
  count(DISTINCT user_id) AS distinct_users, count(DISTINCT movie_id) AS distinct_movies FROM ratings""")),
    "overview_approx": (overview_approx, None),
    "activity_stats": (activity_stats, s.q(
        s.RATINGS, ACTIVITY.format(k="user_id") + " UNION ALL " + ACTIVITY.format(k="movie_id"))),
    "label_stats": (label_stats, s.q(
        s.RATINGS + f",\nlabelled AS (SELECT {LABEL} AS label FROM ratings)",
        """SELECT count(*) AS rows, round(min(label), 8) AS min_label, round(max(label), 8) AS max_label,
  round(avg(label), 8) AS avg_label, round(stddev_samp(label), 8) AS std_label, """
        + QUANTILES.format(v="label", d=8) + " FROM labelled")),
    "label_histogram": (label_histogram, s.q(
        s.RATINGS, "SELECT rating AS label_value, count(*) AS sample_count FROM ratings GROUP BY rating")),
    "similarity_histogram": (similarity_histogram, s.q(SAMPLES, """
SELECT floor(cosine * 20) / 20 AS sim_bin, count(*) AS sample_count, round(avg(label), 8) AS avg_label,
  min(label) AS min_label, max(label) AS max_label, round(avg(cosine), 6) AS avg_cosine_sim
FROM samples WHERE cosine IS NOT NULL GROUP BY 1""")),
    "similarity_histogram_sampled": (similarity_histogram_sampled, None),
    "cosine_stats": (cosine_stats, s.q(SAMPLES, """
SELECT count(*) AS sample_count, round(min(cosine), 6) AS min_cosine, round(max(cosine), 6) AS max_cosine,
  round(avg(cosine), 6) AS avg_cosine, round(stddev_samp(cosine), 6) AS std_cosine, """
        + QUANTILES.format(v="cosine", d=6) + " FROM samples WHERE cosine IS NOT NULL")),
    "vector_shape": (vector_shape, s.q(SAMPLES, """
, lens AS (SELECT user_id, count(*)::INTEGER AS d FROM fused GROUP BY user_id)
SELECT min(d) AS min_user_embedding_len, quantile_cont(d, 0.5) AS p50_user_embedding_len, max(d) AS max_user_embedding_len,
  min(len(embedding))::INTEGER AS min_movie_embedding_len, quantile_cont(len(embedding), 0.5) AS p50_movie_embedding_len,
  max(len(embedding))::INTEGER AS max_movie_embedding_len
FROM samples JOIN lens USING (user_id) JOIN embeddings ON vec_id = movie_id""")),
    "time_extremes": (time_extremes, s.q(s.RATINGS, """
SELECT * FROM (SELECT "timestamp", user_id, movie_id, 'earliest' AS side FROM ratings
               ORDER BY "timestamp", user_id, movie_id LIMIT 5)
UNION ALL
SELECT * FROM (SELECT "timestamp", user_id, movie_id, 'latest' AS side FROM ratings
               ORDER BY "timestamp" DESC, user_id DESC, movie_id DESC LIMIT 5)""")),
}
