"""Readers for rating, item and event files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewheel.functions.text import whole_number

# Header names, trimmed and lower-cased, to column names.
RATING_HEADERS = {
    "userid": "user_id", "user_id": "user_id",
    "movieid": "movie_id", "movie_id": "movie_id",
    "rating": "rating", "timestamp": "timestamp",
}

ID_NAMES = ("movie_id", "movieId", "movieID")
ITEM_VECTOR_NAMES = ("movie_embedding", "embedding", "vector")
USER_VECTOR_NAMES = ("user_embedding", "embedding", "long_term_embedding")
ITEM_VECTOR_FILES = ("movie_embedding.parquet", "movie_embeddings.parquet")

MOVIES = "movieId long, title string, genres string"
LINKS = "movieId long, imdbId string, tmdbId long"
TAGS = "movieId long, tag string"
DETAIL_COLUMNS = (
    "id", "title", "original_title", "overview", "tagline", "genres", "keywords",
    "original_language", "spoken_languages", "production_countries",
    "production_companies", "adult", "release_date",
)


def _csv(spark: SparkSession):
    return (
        spark.read.option("header", True).option("escape", '"').option("quote", '"')
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings as text with canonical column names; fails if one of the four is missing."""
    raw = _csv(spark).csv(path)
    found = {}
    for name in raw.columns:
        canonical = RATING_HEADERS.get(name.strip().lower())
        if canonical and canonical not in found:
            found[canonical] = name
    missing = sorted(set(RATING_HEADERS.values()) - set(found))
    if missing:
        raise ValueError(f"ratings lack columns {missing}")
    return raw.select(*[F.col(f"`{found[c]}`").alias(c) for c in ("user_id", "movie_id", "rating", "timestamp")])


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """The named columns with their types; a value that does not fit becomes NULL."""
    out = []
    for part in schema.split(","):
        name, kind = part.split()
        # ids may be written as 862.0
        value = whole_number(F.col(name)) if kind == "long" else F.col(name)
        out.append(value.alias(name))
    return df.select(*out)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark).csv(path), MOVIES).where(F.col("movieId").isNotNull())


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark).csv(path), LINKS).where(F.col("movieId").isNotNull())


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark).csv(path), TAGS)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Item details; quoted text may run over several lines."""
    raw = _csv(spark).option("multiLine", True).csv(path)
    return _typed(raw, ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in DETAIL_COLUMNS)).where(
        F.col("id").isNotNull()
    )


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, union_by_name: bool = False
) -> DataFrame:
    """A file, folder or glob; ``union_by_name`` merges differing file schemas."""
    df = spark.read.option("mergeSchema", union_by_name).parquet(path)
    return df if columns is None else df.select(*columns)


def read_kind(spark: SparkSession, source: str, kind: str, union_by_name: bool = False) -> DataFrame:
    """Parquet by input kind: a folder of parts, one file, or a version folder."""
    root = source.rstrip("/")
    if kind not in ("parts_prefix", "data_parquet", "version_dir_fallback"):
        raise ValueError(f"unsupported input kind: {kind}")
    return read_parquet(spark, root, None, union_by_name)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below ``path``, with the file and row number of each row."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("file_id"),
            F.col("_metadata.row_index").alias("file_row"),
        )
    )


def version_name(file_path: Column | str) -> Column:
    """The folder below ``versions/`` in a file path."""
    return F.regexp_extract(file_path, "versions/([^/]+)/", 1)


def input_version_time(name: Column | str) -> Column:
    """Time of a 12- or 14-digit version name, NULL for other names."""
    return F.coalesce(
        F.try_to_timestamp(name, F.lit("yyMMddHHmmss")), F.try_to_timestamp(name, F.lit("yyyyMMddHHmmss"))
    )


def vector_version_time(name: Column | str) -> Column:
    """Time of a dashed version name with a two- or four-digit year, NULL for other names."""
    return F.coalesce(
        F.try_to_timestamp(name, F.lit("yy-MM-dd-HH-mm")), F.try_to_timestamp(name, F.lit("yyyy-MM-dd-HH-mm"))
    )


def read_input_versions(
    spark: SparkSession, root: str, names: Sequence[str] | None = None
) -> DataFrame:
    """Watch events of exports: file_id, input_version and input_time beside the columns.

    Files lie in ``versions/<name>/user_event`` or ``user_events``; folders whose name
    is no time are left out.  With ``names`` only these versions are listed and read.
    """
    wanted = "*" if names is None else "{" + ",".join(names) + "}"
    found = read_tree(spark, f"{root.rstrip('/')}/versions/{wanted}/user_event*")
    named = found.withColumn("input_version", version_name(F.col("file_id")))
    return named.withColumn("input_time", input_version_time(F.col("input_version"))).where(
        F.col("input_time").isNotNull()
    )


def read_vector_versions(spark: SparkSession, root: str) -> DataFrame:
    """User vectors of all versions: user_id, version_time, user_embedding (last row wins)."""
    from tidewheel.functions.vectors import parse_vector

    found = read_tree(spark, f"{root.rstrip('/')}/versions")
    vector = pick_column(found, USER_VECTOR_NAMES)
    named = found.withColumn("version_time", vector_version_time(version_name(F.col("file_id"))))
    parsed = named.where(F.col("version_time").isNotNull()).select(
        "user_id",
        "version_time",
        parse_vector(found, vector).alias("user_embedding"),
        F.struct("file_id", "file_row").alias("_at"),
    )
    return (
        parsed.where(F.col("user_embedding").isNotNull())
        .groupBy("user_id", "version_time")
        .agg(F.max_by("user_embedding", "_at").alias("user_embedding"))
    )


def pick_column(df: DataFrame, names: Sequence[str]) -> str:
    """The first of several accepted column names that ``df`` has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {list(names)} is present")


def read_item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Item vectors under either file name and any accepted column name."""
    from tidewheel.sources.files import exists

    for name in ITEM_VECTOR_FILES:
        path = f"{folder.rstrip('/')}/{name}"
        if exists(spark, path):
            df = spark.read.parquet(path)
            return df.select(
                F.col(pick_column(df, ID_NAMES)).cast("long").alias("movie_id"),
                F.col(pick_column(df, ITEM_VECTOR_NAMES)).alias("embedding"),
                F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("ingest_order"),
            )
    raise FileNotFoundError(f"no item vectors in {folder}")


def count_rows(df: DataFrame) -> int:
    """Row count; for a Parquet scan only the footers are read."""
    return df.count()


def estimate_chunks(df: DataFrame, rows: int) -> int:
    return -(-df.count() // rows)
