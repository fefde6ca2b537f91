"""Queries on item metadata and on whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import text
from tidewheel.operators import cleaning, items, retrieval
from tidewheel.plans import sqltext as s
from tidewheel.sources import tables


def collapse_text(spark, folder):
    shown = text.collapse("text")
    return tables.table(spark, folder, "documents").select(
        "doc_id", F.length(shown).alias("chars"), F.md5(shown).alias("digest")
    )


def clean_text(spark, folder):
    shown = text.clean("html")
    return tables.table(spark, folder, "pages").select(
        "page_id", F.length(shown).alias("chars"), F.md5(shown).alias("digest")
    )


def dedupe_list(spark, folder):
    lines = text.distinct_ignoring_case(F.split("text", "\n"))
    return tables.table(spark, folder, "documents").select("doc_id", lines.alias("l")).select(
        "doc_id", F.size("l").alias("lines"), F.md5(F.array_join("l", "|")).alias("digest")
    )


def parse_genres(spark, folder):
    return tables.movies(spark, folder).select("movieId", F.array_join(text.genres("genres"), ",").alias("genres"))


def parse_jsonish(spark, folder):
    found = text.with_jsonish_lists(
        tables.details(spark, folder), {"k": "keywords", "g": "genres", "c": "production_countries"}
    )
    return found.select(
        "id", F.array_join("k", ";").alias("keywords"), F.array_join("g", ";").alias("genres"),
        F.size("c").alias("countries"),
    )


def yes_no(spark, folder):
    return tables.details(spark, folder).select("id", text.yes_no("adult").alias("adult"))


def release_year(spark, folder):
    part = tables.table(spark, folder, "part")
    date = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-05-06")))
    title = F.when(
        F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1900).cast("string"), F.lit(") "))
    ).otherwise(F.col("p_name"))
    return part.select("p_partkey", text.release_year(date, title).alias("release_year"))


def user_names(spark, folder):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))).when(
        F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")
    ).otherwise(F.col("c_name"))
    return tables.table(spark, folder, "customer").select(
        "c_custkey", text.user_from_name(name).alias("user_id")
    )


def top_tags(spark, folder):
    return items.top_tags(tables.tags(spark, folder)).select(
        "movieId", F.array_join("top_user_tags", ",").alias("top_user_tags")
    )


def _joined(spark, folder):
    return items.join_items(
        tables.movies(spark, folder), tables.links(spark, folder),
        tables.details(spark, folder), tables.tags(spark, folder),
    )


def item_join(spark, folder):
    return _joined(spark, folder).select(
        "movieId", "imdbId", "tmdbId", "title", "title_tmdb", "original_title", "release_date",
        F.coalesce(F.size("top_user_tags"), F.lit(0)).alias("tags"),
    )


def item_text(spark, folder):
    return items.embedding_text(_joined(spark, folder)).select("movieId", "embedding_text", "release_year")


def content_filter(spark, folder):
    """Parts of which only the genre, the tagline or the title may be there."""
    part = tables.table(spark, folder, "part")
    empty = F.array().cast("array<string>")
    shown = part.select(
        "p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.col("p_name")).otherwise(F.lit("  ")).alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(empty).alias("genres_list"),
        F.lit("<br>").alias("overview"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("tagline"),
        F.lit(None).cast("array<string>").alias("keywords_list"),
        empty.alias("top_user_tags"),
    )
    return shown.where(text.enough_content()).select("p_partkey")


def title_search(spark, folder):
    return retrieval.search_titles(
        tables.movies(spark, folder).withColumnRenamed("movieId", "movie_id"), " RED ", 25
    ).select("movie_id", "title")


def normalise_items(spark, folder):
    """Recommendation payloads of several shapes, one per event."""
    k = F.get_json_object("props", "$.k")
    listed = F.concat(
        F.lit('[{"movie_id": '), k, F.lit('}, {"item_id": 1'), k, F.lit('}, {"item": "x'), k, F.lit('"}, '),
        k, F.lit(', "n/a", 1e30]'),
    )
    key = F.when(F.col("event_id") % 2 == 0, "recommendations").otherwise("recommend")
    payload = F.concat(F.lit('{"'), key, F.lit('": '), listed, F.lit("}"))
    bodies = tables.table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return cleaning.normalise_items(bodies).select(
        "event_id", F.col("position").cast("long").alias("position"), "movie_id"
    )


def field_vectors(spark, folder):
    """Item vectors from all their texts; pages stand in for long overviews."""
    pages = tables.table(spark, folder, "pages").select(
        F.col("page_id").alias("movieId"), text.clean("html").alias("overview"), F.col("url").alias("title")
    )
    found = items.field_vectors(pages, items.hashing_encoder(64), 64)
    return found.select("movieId", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 5))


SPACE = text.SPACE + "+"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return collapse_sql(f"regexp_replace({collapse_sql(x)}, '<[^>]+>', ' ', 'g')")


TAGS = """tag_counts AS (
  SELECT l_partkey AS id, lower(l_returnflag || ' ' || l_linestatus || l_linenumber) AS tag, count(*) AS uses
  FROM lineitem GROUP BY ALL),
top_tags AS (
  SELECT id, list(tag ORDER BY uses DESC, tag) AS tags FROM (
    SELECT * FROM tag_counts QUALIFY row_number() OVER (PARTITION BY id ORDER BY uses DESC, tag) <= 15) GROUP BY id)"""

ITEM_TEXT = TAGS + """,
fields AS (
  SELECT p_partkey AS id, p_name, p_size, p_type, p_brand, tags, p_size > 5 AND p_size <= 40 AS d
  FROM part LEFT JOIN top_tags ON id = p_partkey)
SELECT id AS movieId, concat_ws(chr(10),
  'Title: ' || p_name,
  CASE WHEN d AND p_size % 2 = 1 THEN 'Original title: ' || p_name || ' II' END,
  'Genres: ' || CASE WHEN d THEN p_type ELSE p_type || ', ' || p_brand END,
  CASE WHEN d AND p_size % 3 = 0 THEN 'Tagline: ' || p_brand END,
  CASE WHEN d THEN 'Overview: Part ' || p_name || ' of ' || p_type END,
  CASE WHEN d THEN 'Keywords: ' || CASE p_size % 4 WHEN 0 THEN p_type || ', ' || p_brand WHEN 1 THEN p_brand || ', ' || p_name
    WHEN 2 THEN p_type || ', ' || p_brand ELSE p_brand || ', ' || p_type END END,
  CASE WHEN len(tags) > 0 THEN 'User tags: ' || array_to_string(tags, ', ') END,
  CASE WHEN d THEN 'Original language: en' END,
  CASE WHEN d THEN 'Spoken languages: English' END,
  CASE WHEN d THEN 'Production companies: "' || p_brand || '"' END,
  CASE WHEN d THEN 'Adult: ' || CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END END,
  CASE WHEN d THEN 'Release year: ' || (p_size + 1950) END) AS embedding_text,
  CASE WHEN d THEN (p_size + 1950)::VARCHAR ELSE '' END AS release_year
FROM fields"""

QUERIES = {
    "collapse_text": (collapse_text, f"""
SELECT doc_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM (SELECT doc_id, {collapse_sql('text')} AS t FROM documents)"""),
    "clean_text": (clean_text, f"""
SELECT page_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM (SELECT page_id, {clean_sql('html')} AS t FROM pages)"""),
    "dedupe_list": (dedupe_list, f"""
WITH tidy AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {clean_sql('x')}), lambda x: x <> '') AS l FROM documents),
kept AS (
  SELECT doc_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM tidy)
SELECT doc_id, len(l)::INTEGER AS lines, md5(array_to_string(l, '|')) AS digest FROM kept"""),
    "parse_genres": (parse_genres, "SELECT p_partkey AS movieId, p_type || ',' || p_brand AS genres FROM part"),
    "parse_jsonish": (parse_jsonish, """
SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_type || ';' || p_brand WHEN 1 THEN p_brand || ';' || p_name
    WHEN 2 THEN p_type || ';' || p_brand ELSE p_brand || ';' || p_type END AS keywords,
  CASE WHEN p_size < 45 THEN p_type ELSE '' END AS genres, 0::INTEGER AS countries FROM part WHERE p_size > 5"""),
    "yes_no": (yes_no, """
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS adult FROM part WHERE p_size > 5"""),
    "release_year": (release_year, """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size + 1950)::VARCHAR WHEN p_size % 3 = 0 THEN (p_size + 1900)::VARCHAR ELSE '' END AS release_year
FROM part"""),
    "user_names": (user_names, """
SELECT c_custkey, CASE WHEN c_custkey % 3 <= 1 THEN c_custkey ELSE TRY_CAST(c_name AS BIGINT) END AS user_id FROM customer"""),
    "top_tags": (top_tags, s.q(TAGS, "SELECT id AS movieId, array_to_string(tags, ',') AS top_user_tags FROM top_tags")),
    "item_join": (item_join, s.q(TAGS, """
SELECT p_partkey AS movieId, 'tt' || p_partkey AS imdbId, CASE WHEN p_size <= 40 THEN p_partkey END AS tmdbId, p_name AS title,
  CASE WHEN p_size BETWEEN 6 AND 40 THEN upper(p_name) END AS title_tmdb,
  CASE WHEN p_size BETWEEN 6 AND 40 THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' II' END END AS original_title,
  CASE WHEN p_size BETWEEN 6 AND 40 THEN (p_size + 1950) || '-01-31' END AS release_date,
  coalesce(len(tags), 0)::INTEGER AS tags FROM part LEFT JOIN top_tags ON id = p_partkey""")),
    "item_text": (item_text, "WITH " + ITEM_TEXT),
    "content_filter": (content_filter, """
SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND (p_size % 2 = 0 OR p_size % 3 = 0)"""),
    "title_search": (title_search, """
SELECT p_partkey AS movie_id, p_name AS title FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_partkey LIMIT 25"""),
    "normalise_items": (normalise_items, s.q(s.USER_EVENTS, """
SELECT event_id, 0::BIGINT AS position, movie_id::VARCHAR AS movie_id FROM user_events
UNION ALL SELECT event_id, 1, '1' || movie_id FROM user_events
UNION ALL SELECT event_id, 2, 'x' || movie_id FROM user_events
UNION ALL SELECT event_id, 3, movie_id::VARCHAR FROM user_events""")),
    "field_vectors": (field_vectors, None),
}
