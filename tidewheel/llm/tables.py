"""Tables, intermediate results and connected components shared by the corpus operators."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewheel.session import shared_folder, shuffle_partitions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/tidewheel-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "rows") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back; survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return max(2, shuffle_partitions(df.sparkSession))


def count_not_above(splitters: Column, count: int, key: Column) -> Column:
    """How many of the ``count`` sorted splitters are not above ``key``, by binary search."""
    steps = [1 << b for b in reversed(range(count.bit_length()))]

    def step(low: Column, width: Column) -> Column:
        to = low + width
        return F.when((to <= count) & (F.get(splitters, to - 1) <= key), to).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) if steps else F.lit(0)


BITS_PER_KEY = 16
MAX_BITS = 1 << 28


class KeyBits(NamedTuple):
    """A bitmap of hashed keys: ``table`` has a row per 4 KB of it, of ``slots`` bits in all."""

    table: DataFrame
    slots: int


def key_bits(keys: DataFrame, place: Column) -> KeyBits:
    """The bitmap of the 64-bit hashes ``place`` of the stored table ``keys``.

    It has ``BITS_PER_KEY`` bits or more for each key but never over ``MAX_BITS`` (32 MB), which
    bounds what is broadcast; with more keys it only tells fewer other rows apart.
    """
    count, slots = keys.count(), 1 << 15
    while slots < min(BITS_PER_KEY * count, MAX_BITS):
        slots *= 2
    at = F.pmod(place, F.lit(slots)) + 1
    found = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return KeyBits(stored(found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bits"), slots)


def may_hold(rows: DataFrame, place: Column, bits: KeyBits, hold: bool = True) -> DataFrame:
    """The rows whose hash has its bit set: all with such a key and a few others; or the rest."""
    at = F.pmod(place, F.lit(bits.slots)) + 1
    bit = F.bitmap_bit_position(at).cast("int")
    byte = F.substring(bits.table["bits"], (bit / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit % 8) == 1
    match = (F.bitmap_bucket_number(at) == bits.table["bucket"]) & is_set
    return rows.join(F.broadcast(bits.table), match, "left_semi" if hold else "left_anti")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node of each connected component, by star contraction.

    Large-star and small-star rounds alternate until every node has one edge, to a node that
    has none; each round keeps at most one row per edge, and the number of rounds grows with
    the logarithm of the longest path.  Edges that are stars already take no round.  Only edges
    are shuffled; the driver sees two counts per round.  Null ends are
    left out; isolated nodes do not appear.
    """
    flow = stored(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        "edges",
    )
    while not _is_star_forest(flow):
        flow = stored(_small_star(_large_star(flow)), "edges")
    return flow.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        flow.select("b", "b").distinct()
    )


def _is_star_forest(flow: DataFrame) -> bool:
    """Whether each larger end has one edge, and no smaller end is the larger one of another."""
    row = flow.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("ends")).first()
    if row["edges"] != row["ends"]:
        return False
    roots = flow.select(F.col("b").alias("root")).distinct()
    return flow.join(roots, F.col("a") == F.col("root"), "left_semi").isEmpty()


def _large_star(flow: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = flow.select("a", "b").union(flow.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        _spread_join(both.where("b > a"), least)
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(flow: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = flow.groupBy("a").agg(F.min("b").alias("m"))
    moved = _spread_join(flow, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _spread_join(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the total of their node; the totals are stored, so that both sides of
    the join come straight from a shuffle and skewed nodes are split at run time."""
    return rows.join(stored(least, "least"), "a")
