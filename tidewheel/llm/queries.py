"""Registered queries of the corpus operators, with SQL twins where SQL can state them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.llm import exact, fingerprint, licenses, mending_queries, mixing, near, packing, shards, tokens, toxicity, warc
from tidewheel.llm.encoders import default_path
from tidewheel.llm.tables import table


def op1_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_pages(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    return exact.content_groups(table(spark, folder, "documents"), keep="largest")


OP2_SQL = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

def op3_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), default_path("word_bpe_49k.json"))


def op4_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return shards.training_order(table(spark, folder, "documents"), default_path("word_bpe_49k.json"))


def op5_jaccard_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


def op6_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), carry=["doc_id"]).drop("copies")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
                 ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY full_at, source IS NULL, source
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         coalesce(least(3.0::DOUBLE * source_size,
                        (SELECT arg_min(level, full_at) FROM l WHERE full_at > level) * w), 3.0::DOUBLE * source_size) AS target
  FROM l),
e AS (
  SELECT doc_id, size, source, source_size, target,
         least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END) AS expected,
         (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t USING (source)
  UNION ALL
  SELECT doc_id, size, d.source, source_size, target,
         least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END),
         (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656.0::DOUBLE
  FROM d JOIN t ON d.source IS NULL AND t.source IS NULL),
p AS (SELECT *, floor(expected) AS sure, expected - floor(expected) AS p FROM e),
z AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + ((u / (1 - u)) / (p / (1 - p)))) END AS z FROM p),
c AS (
  SELECT *, target - sum(size * sure::BIGINT) OVER (PARTITION BY source) AS want,
         coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY z NULLS LAST, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words
  FROM z)
SELECT doc_id, size, source_size, target,
       ((sure::BIGINT + CASE WHEN p > 0 AND words + size / 2.0::DOUBLE < want THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""


def op7_digest_cache(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), default_path("piece_bpe_32k.model"))


def op8_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compared_with_edits(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def _license_values() -> str:
    rows = [
        f"({n}, '{label}', {str(base).lower()}, {pairs}, {at}, '{pair}')"
        for n, label, base, pairs, at, pair in licenses.template_rows()
    ]
    return ", ".join(rows)


OP9_SQL = f"""
WITH t(template, label, base, pairs, t_pos, t_pair) AS (VALUES {_license_values()}),
w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w),
h AS (
  SELECT doc_id, template, label, base, pairs, i - 1 - t_pos AS diagonal, list(DISTINCT t_pos) AS seen
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS pair FROM g) JOIN t ON pair = t_pair
  GROUP BY ALL),
m AS (
  SELECT doc_id, label, base, diagonal, base AND len(seen) = pairs AS place,
         len(list_distinct(flatten(list(seen) OVER (PARTITION BY doc_id, template ORDER BY diagonal
           RANGE BETWEEN {licenses.BAND} PRECEDING AND {licenses.BAND} FOLLOWING)))) / pairs::DOUBLE AS cover
  FROM h),
f AS (
  SELECT doc_id, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word,
         max(diagonal) FILTER (place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR (NOT base AND cover >= {licenses.COVERED})) AS labels,
         max(cover) AS score
  FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN f ON w.doc_id = f.doc_id
"""

def op10_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, net, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


QUERIES = {
    "op1_warc_members": (op1_warc_members, None),
    "op2_content_sort": (op2_content_sort, OP2_SQL),
    "op3_curve_packing": (op3_curve_packing, None),
    "op4_training_order": (op4_training_order, None),
    "op5_jaccard_forest": (op5_jaccard_forest, None),
    "op6_pareto_mix": (op6_pareto_mix, OP6_SQL),
    "op7_digest_cache": (op7_digest_cache, None),
    "op8_multiset_hash": (op8_multiset_hash, None),
    "op9_license_scan": (op9_license_scan, OP9_SQL),
    "op10_toxicity_cnn": (op10_toxicity_cnn, None),
    **mending_queries.QUERIES,
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
