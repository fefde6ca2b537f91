"""Queries on single rules: vectors, requests, versions, lists, snippets, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import text, vectors
from tidewheel.operators import cleaning, events, metrics, profiles, samples
from tidewheel.plans import sqltext as s
from tidewheel.plans.rating_queries import exploded
from tidewheel.sources import tables


def unit_vectors(spark, folder):
    rows = tables.table(spark, folder, "embeddings")
    return exploded(rows.select("vec_id", vectors.unit("embedding").alias("unit")), "vec_id", "unit", 8)


def distance_scores(spark, folder):
    rows = tables.table(spark, folder, "events")
    return rows.select("event_id", F.round(vectors.distance_to_score(F.col("value") / 100), 9).alias("score"))


def parsed_vectors(spark, folder):
    """Vectors as text and back; some texts are no vectors."""
    rows = tables.table(spark, folder, "embeddings")
    odd = F.pmod("vec_id", F.lit(7))
    body = (
        F.when(odd == 1, "no vector").when(odd == 2, "[1.5, null]").when(odd == 3, "[]").when(odd == 4, '"x"')
        .otherwise(vectors.vector_text("embedding"))
    )
    texts = rows.select("vec_id", body.alias("vector"))
    v = vectors.parse_vector(texts, "vector")
    return texts.select(
        "vec_id", F.coalesce(F.size(v), F.lit(-1)).cast("long").alias("dims"), F.round(F.get(v, F.lit(1)), 5).alias("second")
    )


def _versions_of_items(spark, folder):
    """Every item vector twice, the later one reversed; some too short, some absent."""
    rows = tables.table(spark, folder, "embeddings").select("vec_id", "embedding", F.explode(F.array(F.lit(1), F.lit(2))).alias("age"))
    odd = F.pmod(F.col("vec_id") + F.col("age"), F.lit(5))
    v = F.when(F.col("age") == 2, F.reverse("embedding")).otherwise(F.col("embedding"))
    return rows.select("vec_id", "age", F.when(odd == 1, F.slice(v, 1, 3)).when(odd != 2, v).alias("embedding"))


def valid_item_vectors(spark, folder):
    rows = _versions_of_items(spark, folder)
    dim = cleaning.vector_length(rows, "embedding")
    found = [
        cleaning.item_vectors(rows, "vec_id", "embedding", "age", dim, keep).select(
            "movie_id", F.lit(keep).alias("keep"), F.round(F.get("movie_embedding", F.lit(0)).cast("double"), 5).alias("head")
        )
        for keep in ("last", "first")
    ]
    return found[0].unionByName(found[1])


def request_checks(spark, folder):
    """Requests with flaws of every kind."""
    log = tables.table(spark, folder, "events")
    n = F.col("event_id")
    vector = F.array(F.lit(1.0), F.lit(2.0))
    requests = log.select(
        "event_id",
        F.when(n % 13 != 0, n).alias("request_id"), "user_id", F.col("ts").alias("timestamp"),
        F.when(n % 3 != 0, (n % 700).cast("int")).alias("request_k"),
        F.when(n % 17 != 0, vector).otherwise(F.slice(vector, 1, 1)).alias("user_embedding"),
        F.array(F.struct(n.alias("movie_id"), F.when(n % 19 != 0, vector).alias("movie_embedding"))).alias("candidates"),
    )
    return cleaning.check_requests(requests, 2).select("event_id", F.col("request_k").cast("long").alias("request_k"), "problem")


def _snapshots(spark, folder):
    """An embedding version per event; odd events come last, in order."""
    n = F.col("event_id")
    return tables.table(spark, folder, "events").select(
        "user_id", n.alias("embedding_version"), F.when(n % 2 == 1, n).otherwise(-n).alias("updated_at")
    )


def previous_versions(spark, folder):
    return profiles.previous_versions(_snapshots(spark, folder))


def refresh_summary(spark, folder):
    updates = previous_versions(spark, folder).withColumn("source_event_max_id", F.col("user_id") * 10)
    return profiles.refresh_summary(updates)


def tidy_lists(spark, folder):
    rows = tables.table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 != 0, F.array("p_name", F.lit("  "), F.concat(F.lit(" <b>"), "p_type", F.lit("</b>\t")), F.lit(None))).alias("words")
    )
    return rows.select("p_partkey", F.array_join(text.as_list("words"), "|").alias("listed"),
                       F.array_join(text.as_list("p_partkey", "scalar"), "|").alias("single"))


def missing_sessions(spark, folder):
    n = F.col("event_id")
    rows = tables.auth_events(spark, folder)
    holes = rows.withColumn("session_id", F.when(n % 7 == 0, None).when(n % 11 == 0, "").otherwise(F.col("session_id")))
    return events.with_session(holes).select("event_id", "session_id")


def newer_versions(spark, folder):
    found = tables.vector_versions(spark, folder).select("user_id", F.unix_seconds("version_time").alias("version_time"))
    done = found.agg(F.expr("min(version_time) + (max(version_time) - min(version_time)) div 2")).first()[0]
    return samples.newer_versions(found, done).groupBy("version_time").agg(F.count(F.lit(1)).alias("users"))


def score_histogram(spark, folder):
    log = tables.request_log(spark, folder).withColumn("score", F.pmod(F.col("latency_ms"), F.lit(1.25)))
    found = metrics.histogram(log, "score", metrics.SCORE_EDGES, ["env"])
    return found.select("env", F.col("bin").cast("int").alias("bin"), "cumulative")


def returned_histogram(spark, folder):
    """Items returned per request; here an hour of an environment is a request, its events the items."""
    log = tables.request_log(spark, folder)
    returned = log.groupBy("env", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("returned"))
    found = metrics.histogram(returned, "returned", metrics.RETURN_EDGES, ["env"])
    return found.select("env", F.col("bin").cast("int").alias("bin"), "cumulative")


def _histogram_sql(source: str, value: str, edges) -> str:
    limits = ", ".join(f"{float(e)}::DOUBLE" for e in edges) + ", 'inf'::DOUBLE"
    return f"""
SELECT env, i::INTEGER AS bin, count(*) FILTER ({value} <= ([{limits}])[i + 1]) AS cumulative
FROM {source}, (SELECT unnest(range({len(edges) + 1})) AS i) GROUP BY env, i"""


QUERIES = {
    "unit_vectors": (unit_vectors, """
SELECT vec_id, pos, round(v / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) + 1.23e-6::DOUBLE, 8) AS value
FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""),
    "distance_scores": (distance_scores, """
SELECT event_id, round(1.0::DOUBLE - (value / 100.0::DOUBLE) / 2.0::DOUBLE, 9) AS score FROM events"""),
    "parsed_vectors": (parsed_vectors, """
SELECT vec_id, CASE WHEN vec_id % 7 IN (1, 2, 3, 4) THEN -1 ELSE len(embedding) END AS dims,
  CASE WHEN vec_id % 7 NOT IN (1, 2, 3, 4) THEN round(embedding[2]::DOUBLE, 5) END AS second FROM embeddings"""),
    "valid_item_vectors": (valid_item_vectors, """
WITH twice AS (SELECT vec_id, age, embedding FROM embeddings, (SELECT unnest([1, 2]) AS age)),
valid AS (
  SELECT vec_id, age, CASE WHEN age = 2 THEN embedding[len(embedding)] ELSE embedding[1] END AS head
  FROM twice WHERE (vec_id + age) % 5 NOT IN (1, 2))
SELECT vec_id AS movie_id, 'last' AS keep, round(arg_max(head, age)::DOUBLE, 5) AS head FROM valid GROUP BY vec_id
UNION ALL SELECT vec_id, 'first', round(arg_min(head, age)::DOUBLE, 5) FROM valid GROUP BY vec_id"""),
    "request_checks": (request_checks, """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 700 ELSE 10 END AS request_k,
  CASE WHEN event_id % 13 = 0 OR user_id IS NULL OR ts IS NULL THEN 'missing_field'
       WHEN event_id % 3 <> 0 AND event_id % 700 NOT BETWEEN 1 AND 500 THEN 'request_k'
       WHEN event_id % 17 = 0 THEN 'user_embedding' WHEN event_id % 19 = 0 THEN 'movie_embedding' END AS problem
FROM events"""),
    "previous_versions": (previous_versions, """
SELECT user_id, arg_max(event_id, CASE WHEN event_id % 2 = 1 THEN event_id ELSE -event_id END) AS previous_version
FROM events GROUP BY user_id"""),
    "refresh_summary": (refresh_summary, """
WITH p AS (
  SELECT user_id, arg_max(event_id, CASE WHEN event_id % 2 = 1 THEN event_id ELSE -event_id END) AS v FROM events GROUP BY user_id)
SELECT max(v) AS previous_version, max(user_id * 10) AS source_event_max_id, count(*) AS user_count FROM p"""),
    "tidy_lists": (tidy_lists, """
SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || '|' || p_type ELSE '' END AS listed,
  p_partkey::VARCHAR AS single FROM part"""),
    "missing_sessions": (missing_sessions, s.q(s.AUTH_EVENTS, """
SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'fallback-' || user_id || '-' || event_id
                      ELSE session_id END AS session_id FROM auth_events""")),
    "newer_versions": (newer_versions, s.q(s.VERSIONS + """,
timed AS (SELECT epoch(version_time)::BIGINT AS version_time FROM versions)""", """
SELECT version_time, count(*) AS users FROM timed
WHERE version_time > (SELECT min(version_time) + (max(version_time) - min(version_time)) // 2 FROM timed) GROUP BY 1""")),
    "score_histogram": (score_histogram, s.q(
        s.REQUEST_LOG + ",\nscored AS (SELECT env, latency_ms % 1.25::DOUBLE AS score FROM request_log)",
        _histogram_sql("scored", "score", metrics.SCORE_EDGES))),
    "returned_histogram": (returned_histogram, s.q(
        s.REQUEST_LOG + ",\nreturned AS (SELECT env, date_trunc('hour', ts) AS h, count(*) AS n FROM request_log GROUP BY ALL)",
        _histogram_sql("returned", "n", metrics.RETURN_EDGES))),
}
