"""Label transforms over samples and the two train / val / test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewheel.functions import labels
from tidewheel.operators.ordering import HOT_ROWS, number_rows

SPLITS = ("train", "val", "test")


def label_offline(
    samples: DataFrame,
    jitter: str = "blake2b",
    amplitude: float = 0.1,
    k: float = 5.0,
    centre: float = 0.5,
    keep_source: bool = False,
) -> DataFrame:
    """Replace the rating by its jittered sigmoid; ``keep_source`` keeps the steps too."""
    source = F.col(labels.label_source(samples.columns))
    make = {"blake2b": labels.blake2b_jitter, "md5": labels.md5_jitter}[jitter]
    moved = make("user_id", "movie_id", amplitude)
    df = samples.withColumn("_jitter", moved).withColumn("_source", source.cast("double"))
    if keep_source:
        df = df.withColumn("label_raw", F.col("_source")).withColumn(
            "label_jittered", labels.jittered_rating("_source", "_jitter")
        )
    return df.withColumn("label", labels.offline_label("_source", "_jitter", k, centre)).drop(
        "_jitter", "_source"
    )


def label_online(samples: DataFrame, cap: float = 600.0, source: str = "label") -> DataFrame:
    return samples.withColumn("label", labels.online_label(source, cap))


def _cutoffs(ratios: Sequence[float]) -> tuple[float, float]:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must add up to 1")
    return ratios[0], ratios[0] + ratios[1]


def _split_of(share: Column, ratios: Sequence[float]) -> Column:
    train_to, val_to = _cutoffs(ratios)
    return (
        F.when(share < F.lit(train_to), F.lit("train"))
        .when(share < F.lit(val_to), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def split_per_user(
    samples: DataFrame,
    ratios: Sequence[float] = (0.7, 0.1, 0.2),
    order: Sequence[str] = ("timestamp", "movie_id"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Split by the midpoint (seq - 0.5) / n of each row in its user's time line."""
    df = number_rows(samples, ["user_id"], order, "seq_order", "user_total", hot_rows)
    share = (F.col("seq_order") - F.lit(0.5).cast("double")) / F.col("user_total")
    split = F.when(F.col("user_total") == 1, F.lit("train")).otherwise(_split_of(share, ratios))
    return df.withColumn("dataset_split", split)


def split_by_position(
    samples: DataFrame,
    ratios: Sequence[float] = (0.7, 0.1, 0.2),
    order: Sequence[str] = ("user_id", "timestamp", "movie_id"),
) -> DataFrame:
    """First int(0.7 N) rows of the total order train, up to int(0.8 N) val, the rest test.

    Stored row order is not something Spark keeps, so the order is given by columns.
    """
    train_to, val_to = _cutoffs(ratios)
    df = number_rows(samples, [], order, "position", "_rows")
    split = (
        F.when(F.col("position") <= F.floor(F.col("_rows") * F.lit(train_to)), F.lit("train"))
        .when(F.col("position") <= F.floor(F.col("_rows") * F.lit(val_to)), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return df.withColumn("dataset_split", split).drop("_rows")


def dedup_features(
    samples: DataFrame,
    keys: Sequence[str] = ("user_id", "movie_id", "timestamp"),
    tie: Sequence[str] = ("source_key",),
) -> DataFrame:
    """One row per user, item and time: the one with the smallest tie key."""
    rest = [c for c in samples.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*tie)).alias("_first")
    return samples.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*samples.columns)


def rejoin_features(
    index: DataFrame,
    features: DataFrame,
    keys: Sequence[str] = ("user_id", "movie_id", "timestamp"),
) -> DataFrame:
    """Split rows joined back to their wide columns; rows with NULL keys are lost."""
    return index.join(features, list(keys))


def split_counts(split: DataFrame) -> DataFrame:
    """Rows per split in one row."""
    return split.agg(
        *[F.count_if(F.col("dataset_split") == s).alias(f"{s}_rows") for s in SPLITS],
        F.count(F.lit(1)).alias("rows"),
    )


def lost_on_rejoin(index: DataFrame, joined: DataFrame) -> DataFrame:
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return rows(index).select(
        F.col("n").alias("index_rows"), rows(joined).scalar().alias("joined_rows")
    ).withColumn("lost_rows", F.col("index_rows") - F.col("joined_rows"))


def label_audit(split: DataFrame) -> DataFrame:
    """Label range and row share of each split, for checks after a build."""
    grouped = split.groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.min("label").alias("min_label"),
        F.max("label").alias("max_label"),
        F.avg("label").alias("avg_label"),
        F.count_if((F.col("label") <= 0) | (F.col("label") > 1)).alias("out_of_range"),
    )
    total = split.agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("share", F.col("rows") / total.scalar())
