"""Writers: Parquet, JSON lines, splits, table formats, shards, micro-batches, days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidewheel.session import cut_lineage, shuffle_partitions
from tidewheel.sources import files


def write_parquet(
    df: DataFrame, path: str, rows_per_file: int = 50_000, partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stringify(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text; map and struct keys in alphabetical order."""
    out = []
    for field in df.schema:
        kind = field.dataType
        column = F.col(f"`{field.name}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(_sorted_keys(column, kind), {"ignoreNullFields": "false"})
        out.append(column.alias(field.name))
    return df.select(*out)


def _sorted_keys(column, kind):
    if isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        rebuilt = F.struct(*[_sorted_keys(column[n], kind[n].dataType).alias(n) for n in names])
        return F.when(column.isNotNull(), rebuilt)
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(column, lambda x: _sorted_keys(x, kind.elementType))
    return column


def write_splits(
    df: DataFrame, path: str, order: Sequence[str] = ("user_id", "seq_order"), key: str = "user_id",
    rows_per_file: int = 50_000, partitions: int | None = None, spread: int = 64,
) -> None:
    """One folder per split, rows of a user together and in order inside a file.

    The shuffle key is the user and a block of ``order`` positions, so a user with very
    many rows fills several files and not one task.
    """
    position = order[-1]
    block = F.floor(F.col(position) / (rows_per_file * spread))
    placed = df.repartition(partitions, key, block) if partitions else df.repartition(F.col(key), block)
    placed = placed.sortWithinPartitions("dataset_split", *order)
    write_parquet(placed, path, rows_per_file, ["dataset_split"])


def write_buckets(
    df: DataFrame, path: str, buckets: int = 128, order: Sequence[str] = ("user_id", "seq_order"),
    rows_per_file: int = 50_000, spread: int = 64, parts: int | None = None,
) -> None:
    """Split folders cut into hash buckets of users.

    The users of a bucket are dealt over ``parts`` tasks by another hash; by default as many
    as make the number of tasks follow ``spark.sql.shuffle.partitions``.
    """
    from tidewheel.operators.cleaning import hash_bucket

    parts = parts or max(1, shuffle_partitions(df.sparkSession) // buckets)
    placed = df.withColumn("bucket", hash_bucket("user_id", buckets))
    block = F.floor(F.col(order[-1]) / (rows_per_file * spread))
    part = F.pmod(F.xxhash64(F.col("user_id").cast("string"), F.lit("part")), F.lit(parts))
    placed = placed.repartition(F.col("bucket"), part, block).sortWithinPartitions("dataset_split", "bucket", *order)
    write_parquet(placed, path, rows_per_file, ["dataset_split", "bucket"])


def append_table(df: DataFrame, table: str | None, path: str) -> str:
    """Append to a catalog table, made if absent; to a Parquet folder when no table is named."""
    if not table:
        write_parquet(df, path, mode="append")
        return path
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.writeTo(table).append()
    else:
        namespace = table.rsplit(".", 1)[0]
        if namespace != table:
            spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
        df.writeTo(table).create()
    return table


def training_export(
    df: DataFrame, path: str, shards: int, seed: int = 42, ids: Sequence[str] = ("user_id", "movie_id")
) -> None:
    """Rows in random order over ``shards`` files, one input per training worker."""
    need = ["user_embedding", "movie_embedding", "label"]
    missing = sorted(set(need) - set(df.columns))
    if missing:
        raise ValueError(f"training rows lack columns {missing}")
    kept = df.select(*[c for c in ids if c in df.columns], *need)
    # the shuffle order follows from the row itself, so a retried task deals the same rows
    mixed = kept.withColumn("_at", F.xxhash64(*[c for c in ids if c in df.columns], F.col("label"), F.lit(seed)))
    dealt = mixed.repartition(shards, F.col("_at")).sortWithinPartitions("_at").drop("_at")
    dealt.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> str:
    """Rows of one micro-batch in a folder of its own; a repeated batch overwrites it."""
    folder = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return folder


def newest_rows(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """Of all rows of ``write_batch`` folders, those of each key's last batch."""
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return newest.select(*keys, "_row.*")


def last_batch_before(spark, path: str, batch_id: int | None = None) -> str | None:
    """The folder of the greatest batch, or of the greatest one before ``batch_id``."""
    numbers = [int(n.split("=")[1]) for n in files.folders(spark, path) if n.startswith("batch_id=")]
    numbers = [n for n in numbers if batch_id is None or n < batch_id]
    return f"{path}/batch_id={max(numbers)}" if numbers else None


def merge_parts(
    df: DataFrame, path: str, keys: Sequence[str], part: str, batch_id: int, sums: Sequence[str] = (), absent_only: bool = False
) -> None:
    """Upsert the rows of a micro-batch into a table partitioned by ``part``, which follows
    from the keys.

    ``sums`` are added to what a key has; its other columns take the newer row's values, or
    stay as they are with ``absent_only``.  Of several rows of a key in one batch the greatest
    (or smallest) counts.  Only the parts of the batch are read, and only they are overwritten
    (Spark's dynamic partition overwrite).  Each row names the last batch that it holds, so a
    batch that is merged again, even after a commit that broke off between two parts, changes
    nothing.
    """
    spark = df.sparkSession
    parts = [r[part] for r in df.select(part).distinct().collect()]
    if not parts:
        return
    rest = [c for c in df.columns if c not in (*keys, part)]
    others = [c for c in rest if c not in sums]
    rows = df.select(*keys, part, *rest, F.lit(batch_id).cast("long").alias("batch_id"), F.lit(True).alias("_new"))
    if files.has_parquet(spark, path):
        old = spark.read.schema(rows.drop("_new").schema).parquet(path).where(F.col(part).isin(parts))
        rows = old.withColumn("_new", F.lit(False)).unionByName(rows)
    fresh, stale = F.col("_new"), ~F.col("_new")
    done = F.coalesce(F.max(F.when(stale, F.col("batch_id"))) >= batch_id, F.lit(False))
    total = {c: F.coalesce(F.sum(F.when(stale, F.col(c))), F.lit(0)) + F.when(done, 0).otherwise(F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0))) for c in sums}
    place = [F.col("_new"), *others] if absent_only else ["batch_id", "_new", *others]
    picked = (F.min if absent_only else F.max)(F.struct(*place)).alias("_row")
    merged = rows.groupBy(*keys, part).agg(
        *[total[c].cast(rows.schema[c].dataType).alias(c) for c in sums], picked, F.max("batch_id").alias("_last")
    )
    placed = merged.select(*keys, part, *[F.col(f"_row.{c}") if c in others else F.col(c) for c in rest], F.col("_last").alias("batch_id")).repartition(part)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(part).parquet(path)


def merge_days(
    df: DataFrame, path: str, keys: Sequence[str], day: str, batch_id: int, sums: Sequence[str] = ()
) -> None:
    """``merge_parts`` of a table with a partition per day."""
    merge_parts(df, path, keys, day, batch_id, sums)


def insert_absent(df: DataFrame, path: str, keys: Sequence[str], batch_id: int, buckets: int = 64) -> None:
    """Add rows whose key is new; known keys keep what they have.  Of several new rows the
    smallest counts.  The table is partitioned by a hash of the keys."""
    _merge_buckets(df, path, keys, batch_id, buckets, True)


def upsert(df: DataFrame, path: str, keys: Sequence[str], batch_id: int, buckets: int = 64) -> None:
    """Rows of ``df`` replace rows with the same key."""
    _merge_buckets(df, path, keys, batch_id, buckets, False)


def _merge_buckets(df: DataFrame, path: str, keys: Sequence[str], batch_id: int, buckets: int, absent_only: bool) -> None:
    placed = cut_lineage(df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    merge_parts(placed, path, keys, "bucket", batch_id, (), absent_only)
