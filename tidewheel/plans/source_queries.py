"""Queries through files: given tables written by a sink, read back, and compared as they were."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from tidewheel.functions import text
from tidewheel.operators import samples, splits
from tidewheel.plans import datasets, sqltext as s
from tidewheel.plans.rating_queries import SAMPLES, SPLIT_SQL
from tidewheel.session import shared_folder
from tidewheel.sources import readers, sinks, tables


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parquet_round_trip(spark, folder):
    path = _path(spark, "parquet")
    sinks.write_parquet(tables.user_events(spark, folder), path, 1000)
    return readers.read_parquet(spark, path, ["event_id", "user_id", "movie_id"])


def json_round_trip(spark, folder):
    path = _path(spark, "json")
    rows = tables.user_events(spark, folder).select("event_id", "user_id", "session_id", "event_type")
    sinks.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


def _split(spark, folder):
    rows = tables.ratings(spark, folder).select("user_id", "movie_id", "timestamp")
    return splits.split_per_user(rows)


def split_files(spark, folder):
    """Rows and users per split folder, and rows that stand before a smaller one in their file."""
    path = _path(spark, "splits")
    sinks.write_splits(_split(spark, folder), path, ("user_id", "seq_order"), rows_per_file=5000)
    # Two hashes stand for a file: paths shrink in a shuffle, but not in the memory of a sort.
    file = [F.xxhash64(F.lit(seed), "_metadata.file_path").alias(f"file{seed}") for seed in range(2)]
    rows = spark.read.parquet(path).select(
        "dataset_split", "user_id", F.struct("user_id", "seq_order").alias("place"),
        *file, F.col("_metadata.row_index").alias("row"),
    )
    line = W.partitionBy("file0", "file1").orderBy("row")
    late = F.coalesce(F.lag("place").over(line) > F.col("place"), F.lit(False))
    return rows.withColumn("late", late).groupBy("dataset_split").agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("out_of_order")
    )


def bucket_files(spark, folder):
    """Rows per split over hash buckets of users, and users found in more than one bucket."""
    path = _path(spark, "buckets")
    sinks.write_buckets(_split(spark, folder), path, 8, ("user_id", "seq_order"))
    rows = spark.read.parquet(path)
    users = rows.groupBy("dataset_split", "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("buckets"))
    return users.groupBy("dataset_split").agg(F.sum("n").alias("rows"), F.count_if(F.col("buckets") > 1).alias("torn_users"))


def training_files(spark, folder):
    """Training rows after their export in random order over shards."""
    path = _path(spark, "training")
    items = tables.items(spark, folder)
    remaining, users = datasets.offline_inputs(tables.ratings(spark, folder), items)
    rows = samples.attach_vectors(remaining.select("user_id", "movie_id", F.col("rating").alias("label")), users, items)
    sinks.training_export(rows, path, 6)
    return spark.read.parquet(path).select("user_id", "movie_id", "label", F.size("movie_embedding").alias("dim"))


def stringified(spark, folder):
    """Maps, lists and structs as JSON text with sorted keys."""
    rows = tables.table(spark, folder, "orders")
    shaped = rows.select(
        "o_orderkey",
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("m"),
        F.array("o_orderkey", "o_custkey").alias("l"),
        F.struct(F.col("o_custkey").alias("z"), F.lit(None).cast("long").alias("a")).alias("s"),
    )
    return sinks.stringify(shaped)


def version_names(spark, folder):
    """Names in four formats, and one that is no time, read as versions of inputs and of vectors."""
    rows = tables.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    form = lambda f: F.date_format("t", f)
    kind = F.pmod("event_id", F.lit(5))
    name = (
        F.when(kind == 0, form("yyMMddHHmmss")).when(kind == 1, form("yyyyMMddHHmmss"))
        .when(kind == 2, form("yy-MM-dd-HH-mm")).when(kind == 3, form("yyyy-MM-dd-HH-mm")).otherwise("latest")
    )
    return rows.select("event_id", name.alias("name")).select(
        "event_id", F.unix_seconds(readers.input_version_time("name")).alias("input_seconds"),
        F.unix_seconds(readers.vector_version_time("name")).alias("vector_seconds"),
    )


def version_folders(spark, folder):
    """Rows of exported versions by their folder's name; a folder that is no time is left out."""
    root = _path(spark, "exports")
    rows = tables.user_events(spark, folder)
    for part, name in enumerate(("240101000000", "20240201123000", "latest")):
        sinks.write_parquet(rows.where(F.col("event_id") % 3 == part), f"{root}/versions/{name}/user_events", 1000)
    found = readers.read_input_versions(spark, root)
    return found.groupBy("input_version").agg(F.unix_seconds(F.max("input_time")).alias("seconds"), F.count(F.lit(1)).alias("rows"))


def row_counts(spark, folder):
    path = _path(spark, "counts")
    sinks.write_parquet(tables.user_events(spark, folder), path, 1000)
    rows = readers.read_parquet(spark, path)
    return spark.createDataFrame([(readers.count_rows(rows), readers.estimate_chunks(rows, 1000))], "rows long, chunks long")


def field_snippets(spark, folder):
    """Labelled snippets of a text field and a list field for the encoder."""
    part = tables.table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type")).alias("overview"),
        F.array(F.col("p_type"), F.lit("  "), F.col("p_brand")).alias("genres_list"),
    )
    return part.select("p_partkey", text.field_text("overview").alias("overview"), text.field_text("genres_list").alias("genres"))


QUERIES = {
    "parquet_round_trip": (parquet_round_trip, s.q(s.USER_EVENTS, "SELECT event_id, user_id, movie_id FROM user_events")),
    "json_round_trip": (json_round_trip, s.q(s.USER_EVENTS, "SELECT event_id, user_id, session_id, event_type FROM user_events")),
    "split_files": (split_files, s.q(SPLIT_SQL, """
SELECT dataset_split, count(DISTINCT user_id) AS users, count(*) AS rows, 0::BIGINT AS out_of_order FROM per_user GROUP BY dataset_split""")),
    "bucket_files": (bucket_files, s.q(SPLIT_SQL, """
SELECT dataset_split, count(*) AS rows, 0::BIGINT AS torn_users FROM per_user GROUP BY dataset_split""")),
    "training_files": (training_files, s.q(SAMPLES, """
SELECT samples.user_id, samples.movie_id, samples.label, len(embedding)::INTEGER AS dim FROM samples JOIN embeddings ON vec_id = samples.movie_id""")),
    "stringified": (stringified, """
SELECT o_orderkey, '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS m,
  '[' || o_orderkey || ',' || o_custkey || ']' AS l, '{"a":null,"z":' || o_custkey || '}' AS s FROM orders"""),
    "version_names": (version_names, """
SELECT event_id, CASE WHEN event_id % 5 < 2 THEN epoch(date_trunc('second', ts))::BIGINT END AS input_seconds,
  CASE WHEN event_id % 5 IN (2, 3) THEN epoch(date_trunc('minute', ts))::BIGINT END AS vector_seconds FROM events"""),
    "version_folders": (version_folders, """
SELECT CASE event_id % 3 WHEN 0 THEN '240101000000' ELSE '20240201123000' END AS input_version,
  CASE event_id % 3 WHEN 0 THEN epoch(TIMESTAMP '2024-01-01') ELSE epoch(TIMESTAMP '2024-02-01 12:30:00') END::BIGINT AS seconds, count(*) AS rows
FROM events WHERE event_id % 3 < 2 GROUP BY ALL"""),
    "row_counts": (row_counts, "SELECT count(*) AS rows, ceil(count(*) / 1000.0)::BIGINT AS chunks FROM events"),
    "field_snippets": (field_snippets, f"""
SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN '{text.TEXT_LABELS["overview"]}' || p_name || ' ' || p_type ELSE '' END AS overview,
  '{text.TEXT_LABELS["genres_list"]}' || p_type || ', ' || p_brand AS genres FROM part"""),
}
