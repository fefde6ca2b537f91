"""Domain tables read from the driver's star-schema tables.

``lineitem`` and ``orders`` stand in for ratings, ``events`` for watch, login and request
logs, ``embeddings`` for item vectors, ``part`` for item metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, movie_id, rating 0.5..5, timestamp, and source_key as a tie key."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        F.least(F.lit(5.0), F.ceil(F.col("l_quantity") / 5).cast("double") * 0.5).alias("rating"),
        seconds("o_orderdate").alias("timestamp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_key"),
    )


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings as unchecked text: some are no numbers, some implausible, some lack a time, some
    ids are beyond 64 bits or beyond the exact doubles."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rating = F.when(F.col("l_tax") == 0, "n/a").otherwise((F.col("l_quantity") / 10).cast("string"))
    time = F.when(F.col("l_discount") == 0, F.lit(0)).otherwise(seconds("o_orderdate"))
    texts = F.array(*[F.lit(t) for t in ("inf", "1e30", "1e3", "9007199254740993")])
    odd = F.get(texts, F.pmod(F.col("l_orderkey"), F.lit(101)).cast("int"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.when(F.col("l_linenumber") == 7, None)
        .otherwise(F.coalesce(odd, F.col("l_partkey").cast("string")))
        .alias("movie_id"),
        rating.alias("rating"),
        time.cast("string").alias("timestamp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_key"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("movie_id"), F.col("embedding").alias("movie_embedding")
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("event_time", F.col("ts").cast("timestamp"))


def shape_user_events(events: DataFrame) -> DataFrame:
    """All events as watch events; views, clicks and purchases are finished ones."""
    time = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("movie_id"),
        F.concat_ws("-", "user_id", F.date_format(time, "yyyyMMdd")).alias("session_id"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "finish")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        time.alias("event_time"),
        F.col("value").alias("watch_duration_seconds"),
    )


def shape_auth_events(events: DataFrame) -> DataFrame:
    """Sign-ups as logins, errors as logouts."""
    time = F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type") == "signup", "login").when(
        F.col("event_type") == "error", "logout"
    )
    return events.where(F.col("event_type").isin("signup", "error")).select(
        "event_id",
        "user_id",
        F.concat_ws("-", "user_id", F.date_format(time, "yyyyMMdd")).alias("session_id"),
        kind.alias("event_type"),
        time.alias("event_time"),
    )


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_user_events(table(spark, folder, "events"))


def auth_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_auth_events(table(spark, folder, "events"))


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Requests: environment by user, errors are fallbacks, value / 100 is the latency."""
    env = F.element_at(
        F.array(F.lit("staging"), F.lit("canary"), F.lit("prod")),
        (F.pmod("user_id", F.lit(3)) + 1).cast("int"),
    )
    failed = F.col("event_type") == "error"
    return _events(spark, folder).select(
        "event_id",
        F.col("event_time").alias("ts"),
        env.alias("env"),
        F.when(failed, "fallback").otherwise("model").alias("mode"),
        failed.alias("fallback_used"),
        (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("error_"), F.pmod("event_id", F.lit(3)).cast("string"))).alias("error_type"),
        F.col("value").alias("latency_ms"),
        (F.col("value") / 100).alias("latency_s"),
        F.get_json_object("props", "$.k").cast("long").alias("candidates"),
    )


def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """Watch events with the day they were exported on as their input file."""
    day = F.date_format("event_time", "yyyyMMdd")
    return user_events(spark, folder).select(
        "*",
        day.alias("file_id"),
        F.date_trunc("day", F.col("event_time")).alias("input_time"),
    )


def vector_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Daily versions of user vectors: a day's version holds the users who clicked that day.

    The vector is that of the last item clicked, found in ``embeddings`` by its id.
    """
    clicks = (
        _events(spark, folder)
        .where(F.col("event_type") == "click")
        .select(
            "user_id",
            F.date_trunc("day", F.col("event_time")).alias("version_time"),
            "event_id",
            F.get_json_object("props", "$.k").cast("long").alias("movie_id"),
        )
    )
    last = clicks.groupBy("user_id", "version_time").agg(F.max_by("movie_id", "event_id").alias("movie_id"))
    return last.join(items(spark, folder), "movie_id").select(
        "user_id", "version_time", F.col("movie_embedding").alias("user_embedding")
    )


def movies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", "p_type", "p_brand", F.lower("p_type")).alias("genres"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Every part links to itself, sizes above 40 to nothing."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("imdbId"),
        F.when(F.col("p_size") <= 40, F.col("p_partkey")).alias("tmdbId"),
    )


def details(spark: SparkSession, folder: str) -> DataFrame:
    """Details with list fields in JSON, pipe and comma form; small sizes have none."""
    part = table(spark, folder, "part").where(F.col("p_size") > 5)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    objects = F.concat(F.lit('[{"id": 1, "name": '), quoted("p_type"), F.lit('}, {"name": '), quoted("p_brand"), F.lit("}]"))
    strings = F.concat(F.lit("["), quoted("p_brand"), F.lit(", "), quoted("p_name"), F.lit("]"))
    kind = F.pmod("p_size", F.lit(4))
    listed = (
        F.when(kind == 0, objects)
        .when(kind == 1, strings)
        .when(kind == 2, F.concat_ws("|", "p_type", "p_brand"))
        .otherwise(F.concat_ws(",", "p_brand", "p_type"))
    )
    return part.select(
        F.col("p_partkey").alias("id"),
        F.upper("p_name").alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" II"))).alias("original_title"),
        F.concat(F.lit("<b>Part</b>  "), F.col("p_name"), F.lit(" of "), F.col("p_type")).alias("overview"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("tagline"),
        F.when(F.col("p_size") < 45, F.concat(F.lit('[{"id": 1, "name": '), quoted("p_type"), F.lit("}]"))).alias("genres"),
        listed.alias("keywords"),
        F.lit("en").alias("original_language"),
        F.lit("English").alias("spoken_languages"),
        F.lit(None).cast("string").alias("production_countries"),
        quoted("p_brand").alias("production_companies"),
        F.when(F.col("p_size") % 2 == 0, "True").otherwise("no").alias("adult"),
        F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-01-31")).alias("release_date"),
    )


def tags(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    tag = F.concat(F.lit(" <i>"), F.col("l_returnflag"), F.lit("</i> "), F.col("l_linestatus"),
                   F.col("l_linenumber").cast("string"))
    return lines.select(F.col("l_partkey").alias("movieId"), tag.alias("tag"))
