"""Token counts with a cache keyed by content and tokenizer digests.

The cache is a table of (content digest, tokenizer digest, n_tokens).  A run digests every
whole text, looks the digests up, encodes one document per digest that the cache lacks,
appends the new counts, and joins the cache back to all documents.  A second run over the
same or grown data encodes only what is new; another tokenizer file never meets old counts.

Content is normalised only where that cannot change a count: a null text counts as empty.
Texts are shuffled once, in the join that picks the documents to encode; everything else
moves digests.  Appends are committed by Spark, and counts that two runs append for the
same digest are equal, so one of them is read.

Defined cases: an empty text has as many tokens as the library gives it.  Rows with equal
ids, null ids or equal texts each get a row.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.llm.encoders import file_digest, token_counts
from tidewheel.llm.tables import fresh_path, stored, text_or_empty
from tidewheel.llm.words import blocks

CACHE = "digest binary, tokenizer string, n_tokens long"


def open_cache(spark: SparkSession, path: str) -> None:
    """Make sure that the cache table exists; an existing one stays as it is."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)


def known_counts(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    return (
        spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def encode_missing(docs: DataFrame, missing: DataFrame, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """Cache rows for the (digest, id) pairs in ``missing``; ``docs`` has id, digest, text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in blocks(batch.column(1)):
                part = batch.slice(start, stop - start)
                counts = token_counts(tokenizer_path, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([tokenizer] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                    ["digest", "tokenizer", "n_tokens"],
                )

    match = (docs["digest"] == missing["m_digest"]) & docs["id"].eqNullSafe(missing["m_id"])
    return docs.join(missing, match, "left_semi").select("digest", "text").mapInArrow(encode, CACHE)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", limit: int = 4096,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    tokenizer = file_digest(tokenizer_path)
    open_cache(spark, cache_path)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    keys = stored(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = stored(keys.groupBy("digest").agg(F.min("id").alias("m_id")), "distinct")
    missing = distinct.join(known_counts(spark, cache_path, tokenizer), "digest", "left_anti").select(
        F.col("digest").alias("m_digest"), "m_id"
    )
    encode_missing(rows, missing, tokenizer_path, tokenizer).write.mode("append").parquet(cache_path)
    counts = stored(distinct.select("digest").join(known_counts(spark, cache_path, tokenizer), "digest"), "counts")
    return keys.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
