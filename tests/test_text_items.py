"""Text cleaning, list parsing, item texts and vectors."""

import math

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tidewheel.functions import text
from tidewheel.operators import cleaning, items


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [
    (None, ""), ("  a \t b\n", "a b"), ("a  b", "a b"), ("<p>Hi <b>you</b></p>", "Hi you"),
    ("a\x00b", "a b"), ("1 < 2 and 3", "1 < 2 and 3"), ("<>", "<>"), ("x　", "x"),
])
def test_clean(spark, value, want):
    assert one(spark, value, text.clean) == want


def test_collapse_keeps_tags(spark):
    assert one(spark, " <b>x</b>  y", text.collapse) == "<b>x</b> y"


@pytest.mark.parametrize("value,want", [
    (["b", "A", "a", " B ", "", None, "c"], ["b", "A", "c"]), ([], []), (None, []), (["ä", "Ä"], ["ä"]),
])
def test_distinct_ignoring_case(spark, value, want):
    assert one(spark, value, text.distinct_ignoring_case, "array<string>") == want


@pytest.mark.parametrize("value,want", [
    ("Action|Comedy|action", ["Action", "Comedy"]), ("(no genres listed)", []), (None, []), ("Drama", ["Drama"]),
])
def test_genres(spark, value, want):
    assert one(spark, value, text.genres) == want


@pytest.mark.parametrize("value,want", [
    ('[{"id": 1, "name": "Animation"}, {"id": 2, "name": "Comedy"}]', ["Animation", "Comedy"]),
    ('[{"english_name": "French", "iso_639_1": "fr"}, {"name": "", "iso_639_1": "de"}, {"id": 3}]', ["French", "de"]),
    ('["Animation", "Comedy", "comedy"]', ["Animation", "Comedy"]),
    ("[{'id': 1, 'name': 'It\\'s'}, {'name': None, 'english_name': 'X'}]", ["It's", "X"]),
    ("['a', 'b']", ["a", "b"]),
    ('{"name": "Solo"}', ["Solo"]),
    ("{'name': 'Literal'}", ["Literal"]),
    ("[1, 2]", ["1", "2"]),
    ("[]", []),
    ("A|B|a", ["A", "B"]),
    ("A, B,,C", ["A", "B", "C"]),
    ("[broken", ["[broken"]),
    ("[broken, x", ["[broken", "x"]),
    ("Just One", ["Just One"]),
    ("  ", []),
    (None, []),
])
def test_jsonish(spark, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    row = text.with_jsonish_lists(df, {"y": "x"}).first()
    assert row["y"] == want and row.asDict().keys() == {"x", "y"}


def test_small_fields(spark):
    df = spark.createDataFrame(
        [("True", "1999-01-02", "A (2001)"), ("no", "n/a", "B (2001) "), ("maybe", None, "C"), (None, "", "(1999) D")],
        "adult string, d string, t string",
    )
    rows = df.select(text.yes_no("adult").alias("a"), text.release_year("d", "t").alias("y")).collect()
    assert [tuple(r) for r in rows] == [("Yes", "1999"), ("No", "2001"), ("", ""), ("", "")]
    names = spark.createDataFrame([("user_12",), ("12",), ("bob",), ("user_x",), (None,)], "n string")
    assert [r[0] for r in names.select(text.user_from_name("n")).collect()] == [12, 12, None, None, None]


def catalogue(spark):
    movies = spark.createDataFrame(
        [(1, "Toy Story (1995)", "Animation|Comedy"), (2, "", "Drama"), (3, "Plain", "(no genres listed)"), (4, None, "Action")],
        "movieId long, title string, genres string",
    )
    links = spark.createDataFrame([(1, "tt1", 11), (2, "tt2", 12), (3, "tt3", None)], "movieId long, imdbId string, tmdbId long")
    columns = ["id", "title", "original_title", "overview", "tagline", "genres", "keywords", "original_language",
               "spoken_languages", "production_countries", "production_companies", "adult", "release_date"]
    details = spark.createDataFrame(
        [(11, "TS", "toy story (1995)", "x" * 2500, None, '[{"name": "Family"}]', "toys, boys", "en", '[{"english_name": "English"}]',
          None, "Pixar", "False", None),
         (12, "Late title", "Other", None, "<i>tag</i>", None, None, None, None, None, None, None, "2000-05-05"),
         (99, "Unlinked", None, None, None, None, None, None, None, None, None, None, None)],
        ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in columns),
    )
    tags = spark.createDataFrame(
        [(1, "Fun"), (1, "fun "), (1, "<b>pixar</b>"), (1, " "), (None, "x"), (3, None)] + [(1, f"t{i:02d}") for i in range(20)],
        "movieId long, tag string",
    )
    return movies, links, details, tags


def test_item_text(spark):
    movies, links, details, tags = catalogue(spark)
    rows = {r["movieId"]: r for r in items.embedding_text(items.join_items(movies, links, details, tags)).collect()}
    assert set(rows) == {1, 2}  # 3 has nothing but a title, 4 no title
    lines = rows[1]["embedding_text"].split("\n")
    assert lines[0] == "Title: Toy Story (1995)" and not any(l.startswith("Original title") for l in lines)
    assert "Genres: Family" in lines and "Keywords: toys, boys" in lines and "Adult: No" in lines
    assert "Spoken languages: English" in lines and "Production companies: Pixar" in lines
    assert len(next(l for l in lines if l.startswith("Overview: "))) > len("Overview: ") + 2000
    tagged = next(l for l in lines if l.startswith("User tags: "))[11:].split(", ")
    assert tagged == ["fun", "pixar"] + [f"t{i:02d}" for i in range(13)]
    assert lines[-1] == "Release year: 1995"
    assert rows[2]["title"] == "Late title" and rows[2]["tagline"] == "tag" and rows[2]["release_year"] == "2000"
    assert rows[2]["genres_list"] == ["Drama"]


def test_linked_details(spark):
    _, links, details, _ = catalogue(spark)
    assert sorted(r["id"] for r in items.linked_details(details, links).collect()) == [11, 12]


def test_field_vectors(spark):
    rows = [(1, "Red Fox", "red red hen", ["Drama", "Fox"]), (2, "", None, [])]
    df = spark.createDataFrame(rows, "movieId long, title string, overview string, genres_list array<string>")
    got = {r["movieId"]: r["embedding"] for r in items.field_vectors(df, items.hashing_encoder(16), 16).collect()}
    assert got[2] == [0.0] * 16
    hashing = HashingTF(numFeatures=16)
    total, weights = [0.0] * 16, 0.0
    for field, said in (("title", "Title: Red Fox"), ("overview", "Overview: red red hen"), ("genres_list", "Genres: Drama, Fox")):
        vec = [0.0] * 16
        for word in said.lower().split(" "):
            vec[hashing.indexOf(word)] += 1
        size = math.sqrt(sum(v * v for v in vec))
        w = text.FIELD_WEIGHTS[field]
        total = [t + w * v / size for t, v in zip(total, vec)]
        weights += w
    mean = [t / weights for t in total]
    size = math.sqrt(sum(v * v for v in mean))
    assert got[1] == pytest.approx([m / size for m in mean], abs=1e-6)


# ---- cleaning ------------------------------------------------------------------------


def test_clean_ratings(spark):
    rows = [("1", "2", "3.5", "100"), ("1", "x", "3", "100"), (None, "2", "3", "100"), ("1", "2", "0.0", "100"),
            ("1", "2", "5.5", "100"), ("1", "2", "0.5", "0"), ("1", "3", "5.0", "7"), ("1.0", "4", "5", "8"), ("1", "2", "nan", "9")]
    raw = spark.createDataFrame(rows, "user_id string, movie_id string, rating string, timestamp string")
    got = cleaning.clean_ratings(raw)
    assert sorted((r["movie_id"], r["rating"]) for r in got.collect()) == [(2, 3.5), (3, 5.0), (4, 5.0)]
    assert dict(got.dtypes) == {"user_id": "bigint", "movie_id": "bigint", "rating": "double", "timestamp": "bigint"}
    assert cleaning.clean_ratings(raw, drop_invalid=False).count() == 6
    assert tuple(cleaning.clean_stats(raw).first()) == (9, 3, 3, 3)


def test_item_vectors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 2), (2, [1.0], 3), (None, [1.0, 1.0], 4), (3, None, 5)],
        "movie_id long, embedding array<double>, at long",
    )
    pick = lambda keep: {r[0]: r[1] for r in cleaning.item_vectors(df, order="at", dim=2, keep=keep).collect()}
    assert pick("last") == {1: [3.0, 4.0]} and pick("first") == {1: [1.0, 2.0]}
    assert set(r[0] for r in cleaning.item_vectors(df, order="at").collect()) == {1, 2}
    assert cleaning.vector_length(df, "embedding") == 2
    with pytest.raises(ValueError):
        cleaning.vector_length(df.where("movie_id = 3"), "embedding")


def test_parse_vector(spark):
    from tidewheel.functions.vectors import parse_vector, vector_text

    df = spark.createDataFrame([("[1, 2.5]",), ("[1, null]",), ("x",), ("[]",), (None,)], "v string")
    assert [r[0] for r in df.select(parse_vector(df, "v")).collect()] == [[1.0, 2.5], None, None, None, None]
    back = spark.createDataFrame([([1.0, 2.5],)], "v array<double>")
    assert back.select(vector_text("v")).first()[0] == "[1.0,2.5]"


def test_choice(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0]), (2, [], [2.0]), (3, None, None), (4, None, [])],
                               "user_id long, long_term_embedding array<float>, short_term_embedding array<float>")
    assert {r[0]: r[1] for r in cleaning.choose_embeddings(df).collect()} == {1: [1.0], 2: [2.0]}
    assert {r[0]: r[1] for r in cleaning.choice_counts(df).collect()} == {"long_term": 1, "short_term": 1, "none": 2}


def test_rules_and_quarantine(spark):
    df = spark.createDataFrame([("finish", 1.0), ("finish", -1.0), ("view", -2.0), (None, None)],
                               "event_type string, watch_duration_seconds double")
    rules = cleaning.TABLE_RULES["user_events"]
    got = {r["rule"]: (r["rows"], r["violations"]) for r in cleaning.rule_report(df, rules).collect()}
    assert got == {"event_type": (4, 1), "watch_duration": (4, 2)}
    good, bad = cleaning.quarantine(df, rules)
    assert good.count() == 2 and sorted(len(r["broken_rules"]) for r in bad.collect()) == [1, 2]


def test_requests(spark):
    schema = ("request_id string, user_id string, timestamp string, request_k int, user_embedding array<double>, "
              "candidates array<struct<movie_id:string, movie_embedding:array<double>>>")
    ok = [("a", [1.0, 2.0])]
    df = spark.createDataFrame(
        [("r1", "u", "t", None, [1.0, 2.0], ok), ("r2", "u", "t", 501, [1.0, 2.0], ok), ("r3", "u", "t", 5, [1.0], ok),
         ("r4", "u", "t", 5, [1.0, 2.0], [("a", [1.0])]), ("r5", None, "t", 5, [1.0, 2.0], []), ("r6", "u", "t", 5, [1.0, 2.0], [])],
        schema,
    )
    got = {r["request_id"]: (r["request_k"], r["problem"]) for r in cleaning.check_requests(df, 2).collect()}
    assert got == {"r1": (10, None), "r2": (501, "request_k"), "r3": (5, "user_embedding"), "r4": (5, "movie_embedding"),
                   "r5": (5, "missing_field"), "r6": (5, None)}


def test_watch_duration(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 2 else 5.0) for i in range(100)], "id long, d double")
    keyed = [r[0] for r in df.select(cleaning.watch_duration(F.col("d"), F.col("id"))).collect()]
    free = [r[0] for r in df.select(cleaning.watch_duration(F.col("d"))).collect()]
    for values in (keyed, free):
        assert all(v == 5.0 for v in values[::2])
        assert all(900 <= v <= 7200 and v == int(v) for v in values[1::2])


def test_sampling(spark):
    df = spark.createDataFrame([(i, [1.0] if i % 3 else None) for i in range(60)], "user_id long, embedding array<double>")
    a = [r["user_id"] for r in cleaning.sample_profiles(df, 10).collect()]
    b = [r["user_id"] for r in cleaning.sample_profiles(df.repartition(7), 10).collect()]
    assert a == b and len(a) == 10 and all(i % 3 for i in a)
    with pytest.raises(ValueError):
        cleaning.require_columns(df, ["nope"])
