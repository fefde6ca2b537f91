"""Profiles of a growing dataset from one mergeable sketch row per version.

A version is read once, when it is added: distinct counts as HLL sketches, quantiles as KLL
sketches, both Spark's own aggregates.  The profile of all versions is the union of their
rows, a few kilobytes each, so it never scans the versions again.  A version that is added
again replaces its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

LG_BUCKETS = 14  # 16384 buckets: a standard error of 0.8 % of a distinct count
KLL_K = 400  # a rank error below 0.8 %


def add_version(df: DataFrame, root: str, version: str, distinct: Sequence[str], quantiles: Sequence[str]) -> None:
    """Write the sketch row of one version of the data.

    ``distinct`` columns are counted by their text, ``quantiles`` columns are read as DOUBLE.
    Nulls count as no value.
    """
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_BUCKETS)).alias(f"hll_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"kll_{c}") for c in quantiles],
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in quantiles for n, f in (("least", F.min), ("greatest", F.max))],
    )
    row.write.mode("overwrite").parquet(f"{root}/version={version}")


def overview(spark: SparkSession, root: str, probs: Mapping[str, float]) -> DataFrame:
    """One row over all versions: versions, rows, distinct_<column>, and per quantile column
    least, greatest and one column for each of ``probs`` (name to p)."""
    rows = spark.read.parquet(root)
    distinct = [c[4:] for c in rows.columns if c.startswith("hll_")]
    quantiles = [c[4:] for c in rows.columns if c.startswith("kll_")]
    whole = rows.agg(
        F.count(F.lit(1)).alias("versions"),
        F.sum("rows").alias("rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"hll_{c}", F.lit(True))).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_merge_agg_double(f"kll_{c}", F.lit(KLL_K)).alias(f"kll_{c}") for c in quantiles],
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in quantiles for n, f in (("least", F.min), ("greatest", F.max))],
    )
    picked = [F.kll_sketch_get_quantile_double(f"kll_{c}", F.lit(float(p))).alias(f"{n}_{c}") for c in quantiles for n, p in probs.items()]
    return whole.select(*[c for c in whole.columns if not c.startswith("kll_")], *picked)
