"""The batch jobs a user schedules: files in, a version with manifest and registry out."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.operators import cleaning, items, profiles, profiling, samples, splits
from tidewheel.plans import datasets
from tidewheel.session import cut_lineage
from tidewheel.sources import files, readers, sinks
from tidewheel.sources.versions import MARK, VersionedDataset

PROFILE_COLUMNS = ["user_id", "long_term_embedding", "short_term_embedding", "profile_version"]
REMAINING_COLUMNS = ["user_id", "movie_id", "rating", "timestamp", "event_time", "future_event_order"]


def item_text_build(
    spark: SparkSession, movies: str, links: str, tags: str, details: str, out: str
) -> DataFrame:
    """CSV metadata to item texts, as Parquet and as JSON lines beside it."""
    joined = items.join_items(
        readers.read_movies(spark, movies), readers.read_links(spark, links),
        readers.read_details(spark, details), readers.read_tags(spark, tags),
    )
    sinks.write_parquet(items.embedding_text(joined), f"{out}/movie_embedding_text")
    made = spark.read.parquet(f"{out}/movie_embedding_text")
    sinks.write_json_lines(made, f"{out}/movie_embedding_text_json")
    return made


def item_vector_build(spark: SparkSession, texts: DataFrame, out: str, encode=None, dim: int = 384) -> DataFrame:
    """Field-weighted item vectors under the name readers look for."""
    made = items.field_vectors(texts, encode or items.hashing_encoder(dim), dim)
    kept = ["movieId", "imdbId", "tmdbId", "title", "original_title", "release_year", "adult",
            "original_language", "genres_list", "keywords_list", "top_user_tags", "embedding"]
    path = f"{out}/movie_embeddings.parquet"
    sinks.write_parquet(made.select(*[c for c in kept if c in made.columns]), path)
    return spark.read.parquet(path)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """Valid item vectors of one length, the last of several rows per id, as a written table."""
    raw = readers.read_item_vectors(spark, folder)
    dim = cleaning.vector_length(raw, "embedding")
    return cut_lineage(cleaning.item_vectors(raw, order="ingest_order", dim=dim))


def profile_build(
    spark: SparkSession, ratings: str, item_folder: str, out: str, version: str = "v1", **cut_options
) -> dict:
    """Ratings CSV to the four profile tables and a manifest with all counts."""
    raw = readers.read_ratings(spark, ratings)
    # lines of a CSV carry no position; ties in time are settled by item, then rating
    placed = cleaning.clean_ratings(raw).withColumn("source_key", F.lit(0).cast("long"))
    base = datasets.base_tables(placed, read_items(spark, item_folder), version, **cut_options)
    for name, df in base.items():
        df = df.drop("boot_n")
        if name in ("base_users", "base_user_profiles"):
            df = df.withColumn("built_at", F.current_timestamp())
        sinks.write_parquet(df, f"{out}/{name}")
    stored = spark.read.parquet(f"{out}/base_user_profiles")
    stats = cleaning.clean_stats(raw).first().asDict()
    totals = stored.agg(
        F.count(F.lit(1)).alias("users_kept"),
        F.count("long_term_embedding").alias("users_with_long_vector"),
        F.count("short_term_embedding").alias("users_with_short_vector"),
    ).first().asDict()
    manifest = {"profile_version": version, "cleaning": stats, **totals}
    files.write_json(spark, f"{out}/manifest.json", manifest)
    return manifest


def preflight(profile_rows: DataFrame, remaining: DataFrame, vectors: DataFrame, weights: tuple[float, float]) -> None:
    """Fail on missing columns or unusable weights before any row is read."""
    cleaning.require_columns(profile_rows, PROFILE_COLUMNS, "profiles")
    cleaning.require_columns(remaining, REMAINING_COLUMNS, "remaining events")
    cleaning.require_columns(vectors, ["movie_id", "movie_embedding"], "item vectors")
    if min(weights) < 0 or sum(weights) == 0:
        raise ValueError("fuse weights must not be negative and not both zero")


def offline_build(
    spark: SparkSession, base: str, item_folder: str, out: str, weights: tuple[float, float] = (0.4, 0.6),
    rows_per_file: int = 50_000, table: str | None = None,
) -> dict:
    """Profiles and remaining events to a new version of positive samples."""
    stored = spark.read.parquet(f"{base}/base_user_profiles")
    remaining = spark.read.parquet(f"{base}/remaining_user_events")
    vectors = read_items(spark, item_folder)
    preflight(stored, remaining, vectors, weights)
    data = VersionedDataset(spark, out)
    version = data.claim_version()
    fused = f"{data.folder(version)}/fused_users"
    sinks.write_parquet(profiles.fused_users(stored, *weights), fused)
    found = samples.offline_samples(remaining, spark.read.parquet(fused), vectors)
    counts = {r["source"]: r["users"] for r in profiles.fuse_counts(stored).collect()}
    manifest = data.write({"parts": found}, version, {"fused": counts, "weights": list(weights)}, rows_per_file)
    if table:
        sinks.append_table(spark.read.parquet(manifest["parts"]["parts"]), table, out)
    return manifest


def split_build(
    spark: SparkSession, source: str, out: str, kind: str = "offline", strategy: str = "by_position",
    jitter: str = "blake2b", cap: float = 600.0, ratios=(0.7, 0.1, 0.2), version: str | None = None,
) -> dict:
    """Newest samples to labelled train, val and test folders of a new version."""
    path, how = VersionedDataset(spark, source).latest_source()
    kept, place = split_rows(readers.read_kind(spark, path, how), kind, strategy, jitter, cap, ratios)
    data = VersionedDataset(spark, out)
    version = version or data.claim_version()
    whole = f"{data.folder(version)}/dataset_split"
    sinks.write_splits(kept, whole, ("user_id", place))
    written = spark.read.parquet(whole)
    counted = splits.split_counts(written).first().asDict()
    manifest = {
        "version": version, "status": "ok", "input": path, "strategy": strategy, "ratios": list(ratios), **counted,
        "data_parts_prefix": whole, "parts": {s: f"{whole}/dataset_split={s}" for s in splits.SPLITS},
    }
    data.commit(manifest)
    return manifest


def split_rows(
    rows: DataFrame, kind: str = "offline", strategy: str = "by_position", jitter: str = "blake2b", cap: float = 600.0,
    ratios=(0.7, 0.1, 0.2),
) -> tuple[DataFrame, str]:
    """Labelled and split rows of Parquet samples, and the name of their position column.

    Rows are numbered and labelled by their narrow columns, with the file and row they came
    from; both vectors are joined to the finished rows by that key.
    """
    cleaning.require_columns(rows, ["user_id", "movie_id", "user_embedding", "movie_embedding", "label"], "samples")
    order = [c for c in ("timestamp", "event_id") if c in rows.columns]
    keyed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    wide = ("user_embedding", "movie_embedding")
    narrow = cut_lineage(keyed.drop(*wide))
    if strategy == "per_user":
        placed = splits.split_per_user(narrow, ratios, [*order, "movie_id", "label"])
        place = "seq_order"
    elif strategy == "by_position":
        placed = splits.split_by_position(narrow, ratios, ["user_id", *order, "movie_id", "label"])
        place = "position"
    else:
        raise ValueError(f"unknown split strategy: {strategy}")
    label = {"offline": lambda df: splits.label_offline(df, jitter), "online": lambda df: splits.label_online(df, cap)}
    labelled = label[kind](placed).select("user_id", "movie_id", "label", place, "dataset_split", "_file", "_row")
    joined = labelled.join(keyed.select(*wide, "_file", "_row"), ["_file", "_row"])
    return joined.select("user_id", "movie_id", *wide, "label", place, "dataset_split"), place


def online_build(
    spark: SparkSession, inputs: str, vectors: str, item_folder: str, out: str, threshold: float = 0.8,
    rows_per_file: int = 50_000,
) -> dict:
    """Samples from the input versions that came after the last build.

    A version without rows, or older than every vector version, adds nothing but is not
    looked at again.  The mark of what was processed is part of the version's manifest, so
    a build that dies is either wholly there or done again, under the next number.
    """
    data = VersionedDataset(spark, out)
    mark = data.registry().get(MARK)
    found = files.folders(spark, f"{inputs}/versions")
    timed = {}
    if found:
        named = spark.createDataFrame([(n,) for n in found], "name string")
        parsed = named.select("name", readers.input_version_time("name").alias("t")).where("t IS NOT NULL").collect()
        timed = {r["name"]: r["t"] for r in parsed}
    new = {n: t for n, t in timed.items() if mark is None or t > timed.get(mark, t)}
    status = samples.build_status(len(timed), len(new))
    if status != "ok":
        return {"status": status, "version": None}
    holding = [
        n for n in sorted(new)
        if any(files.has_parquet(spark, f"{inputs}/versions/{n}/{f}") for f in ("user_event", "user_events"))
    ]
    latest = max(new, key=lambda n: new[n])
    if not holding:
        _mark_processed(data, latest)
        return {"status": "ok", "version": None}
    events = readers.read_input_versions(spark, inputs, holding)
    made = samples.online_samples(
        events, cut_lineage(readers.read_vector_versions(spark, vectors)), read_items(spark, item_folder), threshold
    )
    manifest = data.write(
        {"parts": made}, None, {"input_versions": sorted(new, key=lambda n: new[n]), MARK: latest}, rows_per_file
    )
    return manifest


def _mark_processed(data: VersionedDataset, name: str) -> None:
    registry = data.registry()
    registry[MARK] = name
    files.write_json(data.spark, f"{data.root}/registry/version.json", registry)


def profile_report(df: DataFrame, path: str, blocks: Mapping[str, bool] | None = None) -> dict:
    """All profile blocks as one JSON file; each block is a few rows."""
    cached = cut_lineage(df)
    report = {
        name: [json.loads(r) for r in block.toJSON().collect()]
        for name, block in profiling.profile(cached, blocks).items()
    }
    files.write_json(df.sparkSession, path, report)
    return report
