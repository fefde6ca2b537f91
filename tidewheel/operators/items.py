"""Item metadata: joins, tags, texts and field-weighted vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewheel.functions import text, vectors
from tidewheel.session import cut_lineage


def linked_details(details: DataFrame, links: DataFrame) -> DataFrame:
    """Detail rows whose id some link points to."""
    return details.join(links.select(F.col("tmdbId").alias("id")), "id", "left_semi")


def top_tags(tags: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent cleaned lower-case tags per item, most frequent first."""
    # equal spellings are counted before they are cleaned: far fewer strings to clean
    spelled = tags.where(F.col("movieId").isNotNull()).groupBy("movieId", "tag").agg(
        F.count(F.lit(1)).alias("uses")
    )
    counted = (
        spelled.select("movieId", F.lower(text.clean("tag")).alias("tag"), "uses")
        .where(F.col("tag") != "")
        .groupBy("movieId", "tag")
        .agg(F.sum("uses").alias("uses"))
    )
    line = W.partitionBy("movieId").orderBy(F.desc("uses"), "tag")
    return (
        counted.withColumn("place", F.row_number().over(line))
        .where(F.col("place") <= k)
        .groupBy("movieId")
        .agg(F.sort_array(F.collect_list(F.struct("place", "tag"))).alias("_tags"))
        .select("movieId", F.col("_tags.tag").alias("top_user_tags"))
    )


def join_items(movies: DataFrame, links: DataFrame, details: DataFrame, tags: DataFrame) -> DataFrame:
    """Movies with their links, details and top tags, where these exist."""
    listed = linked_details(details, links).select(
        F.col("id").alias("tmdbId"),
        F.col("title").alias("title_tmdb"),
        *[c for c in details.columns if c not in ("id", "title", "genres")],
        F.col("genres").alias("genres_tmdb"),
    )
    return (
        movies.join(links, "movieId", "left")
        .join(listed, "tmdbId", "left")
        .join(top_tags(tags), "movieId", "left")
    )


def embedding_text(joined: DataFrame) -> DataFrame:
    """Cleaned fields and the item text, for items with enough content.

    Details' genres win where present; the movie's own title wins over the details'.
    Enough content includes a title, so the text is never empty.
    """
    own, other = text.genres("genres"), F.col("_genres")
    title = F.coalesce(F.nullif(text.clean("title"), F.lit("")), text.clean("title_tmdb"))
    listed = text.with_jsonish_lists(
        joined,
        {
            "_genres": "genres_tmdb",
            "keywords_list": "keywords",
            "spoken_languages_list": "spoken_languages",
            "production_countries_list": "production_countries",
            "production_companies_list": "production_companies",
        },
    )
    cleaned = F.struct(
        "movieId",
        "imdbId",
        "tmdbId",
        title.alias("title"),
        text.clean("original_title").alias("original_title"),
        text.release_year("release_date", "title").alias("release_year"),
        text.yes_no("adult").alias("adult"),
        text.clean("original_language").alias("original_language"),
        F.when(F.size(other) > 0, other).otherwise(own).alias("genres_list"),
        "keywords_list",
        "spoken_languages_list",
        "production_countries_list",
        "production_companies_list",
        F.coalesce("top_user_tags", F.array().cast("array<string>")).alias("top_user_tags"),
        text.clean("tagline").alias("tagline"),
        text.clean("overview").alias("overview"),
    )
    # As the only entry of a generated list the fields are computed once; Spark would move the
    # filter below a plain projection and clean every field twice.
    fields = listed.select(F.inline(F.array(cleaned)))
    return (
        fields.where(text.enough_content(cleaned=True))
        .withColumn("embedding_text", text.item_text(cleaned=True))
    )


def hashing_encoder(dim: int = 384) -> Callable[[DataFrame], DataFrame]:
    """Unit vectors of hashed word counts; a stand-in any text encoder can replace.

    An encoder takes rows with a ``text`` column and adds ``vector`` ARRAY<DOUBLE>.
    """

    def encode(df: DataFrame) -> DataFrame:
        words = Tokenizer(inputCol="text", outputCol="_words").transform(df)
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(words)
        scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counts)
        return scaled.withColumn("vector", vector_to_array("_unit")).drop("_words", "_counts", "_unit")

    return encode


def field_vectors(
    items: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    dim: int = 384,
    weights: Mapping[str, float] = text.FIELD_WEIGHTS,
    key: str = "movieId",
) -> DataFrame:
    """Σ weight · vec(field) / Σ weight over non-empty fields, scaled to length 1.

    Items without any text get the zero vector.
    """
    present = [f for f in weights if f in items.columns]
    parts = F.array(
        *[F.struct(F.lit(float(weights[f])).alias("weight"), text.field_text(f).alias("text")) for f in present]
    )
    rows = items.select(key, F.inline(parts)).where(F.col("text") != "")
    mean = vectors.weighted_mean(encode(rows), [key], "vector", "weight", "_mean")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return items.join(mean, key, "left").withColumn(
        "embedding",
        F.when(F.col("_mean").isNotNull(), vectors.unit("_mean").cast("array<float>")).otherwise(zero),
    ).drop("_mean")
