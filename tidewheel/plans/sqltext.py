"""SQL building blocks of the check queries: the domain tables as common table expressions."""

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS movie_id,
         least(5.0::DOUBLE, ceil(l_quantity / 5)::DOUBLE * 0.5::DOUBLE) AS rating,
         epoch(o_orderdate)::BIGINT AS "timestamp",
         (l_orderkey * 8 + l_linenumber)::BIGINT AS source_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RAW_RATINGS = """raw AS (
  SELECT o_custkey::VARCHAR AS user_id,
         CASE WHEN l_linenumber = 7 THEN NULL
           ELSE coalesce(['inf', '1e30', '1e3', '9007199254740993'][l_orderkey % 101 + 1], l_partkey::VARCHAR) END AS movie_id,
         CASE WHEN l_tax = 0 THEN 'n/a' ELSE (l_quantity / 10)::VARCHAR END AS rating,
         CASE WHEN l_discount = 0 THEN '0' ELSE epoch(o_orderdate)::BIGINT::VARCHAR END AS "timestamp",
         (l_orderkey * 8 + l_linenumber)::BIGINT AS source_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
numbers AS (
  SELECT TRY_CAST(user_id AS BIGINT) AS user_id, TRY_CAST(movie_id AS BIGINT) AS movie_id,
         TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST("timestamp" AS BIGINT) AS "timestamp",
         source_key,
         user_id IS NOT NULL AND TRY_CAST(movie_id AS BIGINT) IS NOT NULL
           AND TRY_CAST(rating AS DOUBLE) IS NOT NULL AS complete
  FROM raw)"""

TIMELINE = RATINGS + """,
timeline AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", source_key, movie_id, rating) AS event_order,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM ratings)"""

CUT = TIMELINE + """,
bounded AS (
  SELECT *, least(greatest(3, floor(n * 0.7::DOUBLE)::BIGINT), n - 1) AS boot_n FROM timeline),
cut AS (
  SELECT *, CASE WHEN event_order <= boot_n THEN 'bootstrap' ELSE 'remaining' END AS part,
         CASE WHEN event_order > boot_n THEN event_order - boot_n END AS future_event_order
  FROM bounded WHERE n >= 5 AND boot_n >= 3 AND n - boot_n >= 1)"""

BOOT = CUT + """,
boot AS (
  SELECT user_id, movie_id, rating, "timestamp", event_order, boot_n, source_key,
         rating >= 4.0 AS is_positive,
         rating - avg(rating) OVER (PARTITION BY user_id) AS rating_centered,
         exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE
             * ((max("timestamp") OVER (PARTITION BY user_id) - "timestamp")::DOUBLE / 86400.0::DOUBLE)) AS time_weight
  FROM cut WHERE part = 'bootstrap')"""

VECTORS = """item_values AS (
  SELECT vec_id AS movie_id, unnest(embedding)::DOUBLE AS v,
         generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings)"""


def preference(name: str, extra: str = "") -> str:
    return f"""{name}_w AS (
  SELECT user_id, movie_id, sum(greatest(rating - 3.5::DOUBLE, 0) * time_weight) AS w
  FROM boot WHERE rating > 3.5 {extra} GROUP BY user_id, movie_id),
{name} AS (
  SELECT user_id, pos, round(sum(w * v) / sum(w), 12)::FLOAT AS value
  FROM {name}_w JOIN item_values USING (movie_id)
  GROUP BY user_id, pos HAVING sum(w) > 1e-8)"""


PROFILES = (
    BOOT
    + ",\n"
    + VECTORS
    + ",\n"
    + preference("long_v")
    + ",\n"
    + preference("short_v", "AND event_order > boot_n - 10")
)

FUSED = PROFILES + """,
fused AS (
  SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(l.pos, s.pos) AS pos,
         (CASE WHEN l.value IS NOT NULL AND s.value IS NOT NULL
               THEN l.value::DOUBLE * 0.4::DOUBLE + s.value::DOUBLE * 0.6::DOUBLE
               ELSE coalesce(s.value, l.value)::DOUBLE END)::FLOAT AS value
  FROM long_v l FULL JOIN short_v s ON l.user_id = s.user_id AND l.pos = s.pos)"""

USER_EVENTS = """user_events AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS movie_id,
         user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS session_id,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'finish' ELSE event_type END AS event_type,
         ts AS event_time, value AS watch_duration_seconds
  FROM events)"""

AUTH_EVENTS = """auth_events AS (
  SELECT event_id, user_id, user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS session_id,
         CASE WHEN event_type = 'signup' THEN 'login' ELSE 'logout' END AS event_type, ts AS event_time
  FROM events WHERE event_type IN ('signup', 'error'))"""

ACTIVITY = USER_EVENTS + ",\n" + AUTH_EVENTS + """,
activity AS (
  SELECT event_id, user_id, session_id, event_type, event_time, 0.0::DOUBLE AS watch_duration_seconds FROM auth_events
  UNION ALL
  SELECT event_id, user_id, session_id, event_type, event_time, watch_duration_seconds
  FROM user_events WHERE event_type = 'finish')"""

REQUEST_LOG = """request_log AS (
  SELECT event_id, ts, ['staging', 'canary', 'prod'][(user_id % 3 + 1)] AS env,
         CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'model' END AS mode,
         event_type = 'error' AS fallback_used, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN 'error_' || (event_id % 3) END AS error_type,
         value AS latency_ms, value / 100 AS latency_s,
         json_extract_string(props, '$.k')::BIGINT AS candidates
  FROM events)"""

VERSIONS = USER_EVENTS + """,
inputs AS (
  SELECT *, strftime(event_time, '%Y%m%d') AS file_id, date_trunc('day', event_time) AS input_time FROM user_events),
last_click AS (
  SELECT user_id, date_trunc('day', ts) AS version_time,
         arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS movie_id
  FROM events WHERE event_type = 'click' GROUP BY 1, 2),
versions AS (
  SELECT user_id, version_time, movie_id AS source_item, embedding AS user_embedding
  FROM last_click JOIN embeddings ON vec_id = movie_id)"""


def picks(threshold: float) -> str:
    return VERSIONS + f""",
counts AS (SELECT file_id, input_time, user_id, count(*) AS user_rows FROM inputs GROUP BY ALL),
newest AS (
  SELECT file_id, counts.user_id, user_rows, max(version_time) AS version_time
  FROM counts JOIN versions ON counts.user_id = versions.user_id AND version_time <= input_time
  GROUP BY ALL),
totals AS (SELECT file_id, sum(user_rows) AS file_rows FROM counts GROUP BY file_id),
visited AS (
  SELECT file_id, version_time,
         coalesce(sum(sum(user_rows)) OVER (PARTITION BY file_id ORDER BY version_time DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen_before
  FROM newest GROUP BY file_id, version_time),
picks AS (
  SELECT newest.* FROM newest JOIN visited USING (file_id, version_time) JOIN totals USING (file_id)
  WHERE seen_before::DOUBLE / file_rows::DOUBLE < {threshold}::DOUBLE)"""


def q(prefix: str, body: str) -> str:
    return f"WITH {prefix}\n{body}"
