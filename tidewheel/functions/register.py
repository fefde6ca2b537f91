"""Names for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewheel.functions import labels


def register(spark: SparkSession) -> None:
    """``blake2b_share(key)``: the hash of a text as a share of 2^64 - 1."""
    spark.udf.register("blake2b_share", labels._blake2b_share)
