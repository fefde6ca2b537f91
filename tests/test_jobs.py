"""The scheduled jobs end to end, from CSV files to training exports."""

import random
from datetime import datetime

import pytest

from tidewheel.functions.register import register
from tidewheel.operators import cleaning
from tidewheel.plans import jobs
from tidewheel.sources import files, readers, sinks
from tidewheel.sources.versions import VersionedDataset


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    rnd = random.Random(1)
    rows = ["userId,movieId,rating,timestamp"]
    for user in range(1, 8):
        for _ in range(2 if user == 7 else 20):
            rows.append(f"{user},{rnd.randrange(1, 15)},{rnd.randrange(1, 11) / 2},{1_600_000_000 + rnd.randrange(10**6)}")
    rows.append("x,1,2,3")
    (root / "ratings.csv").write_text("\n".join(rows))
    (root / "movies.csv").write_text("movieId,title,genres\n" + "\n".join(f"{m},Film {m} (19{80 + m}),Drama|G{m % 3}" for m in range(1, 13)))
    (root / "links.csv").write_text("movieId,imdbId,tmdbId\n" + "\n".join(f"{m},tt{m},{m}" for m in range(1, 13)))
    (root / "tags.csv").write_text("movieId,tag\n1,fun\n1,Fun\n2,dark\n")
    header = ",".join(readers.DETAIL_COLUMNS)
    (root / "tmdb.csv").write_text(header + "\n" + "\n".join(f'{m},T{m},,"Story {m},\nlong",,,,en,,,,False,' for m in range(1, 13)))
    p = lambda n: str(root / n)
    texts = jobs.item_text_build(spark, p("movies.csv"), p("links.csv"), p("tags.csv"), p("tmdb.csv"), p("items"))
    jobs.item_vector_build(spark, texts, p("items"), dim=16)
    return p


def test_item_builds(spark, world):
    assert spark.read.json(world("items/movie_embedding_text_json")).count() == 12
    items = jobs.read_items(spark, world("items"))
    assert items.count() == 12 and cleaning.vector_length(items, "movie_embedding") == 16


@pytest.mark.parametrize("strategy", ["by_position", "per_user"])
def test_no_vector_goes_through_a_window(spark, tmp_path, strategy):
    n = 500
    df = spark.range(n).selectExpr(
        "id % 7 AS user_id", "id AS movie_id", "id * 3 AS timestamp", "array(1.0, double(id)) AS user_embedding",
        "array(double(id)) AS movie_embedding", "double(id % 5) + 0.5 AS label",
    )
    df.repartition(5).write.parquet(str(tmp_path / "rows"))
    kept, place = jobs.split_rows(spark.read.parquet(str(tmp_path / "rows")), strategy=strategy)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert all("embedding" not in line for line in windows) and "embedding" not in "".join(_below(plan, "Window "))
    rows = kept.collect()
    assert len(rows) == n and all(r["movie_embedding"] == [float(r["movie_id"])] for r in rows)
    assert all(r["user_embedding"] == [1.0, float(r["movie_id"])] for r in rows)


def _below(plan: str, node: str) -> list[str]:
    """Lines of a plan that stand under a node."""
    out, depth = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" +-:"))
        if depth is not None and indent <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        if depth is None and line.lstrip(" +-:").startswith(node):
            depth = indent
    return out


def test_offline_chain(spark, world):
    manifest = jobs.profile_build(spark, world("ratings.csv"), world("items"), world("base"))
    assert manifest["users_kept"] == 6 and manifest["cleaning"]["dropped_null"] == 1
    assert "built_at" in spark.read.parquet(world("base/base_users")).columns
    built = jobs.offline_build(spark, world("base"), world("items"), world("offline"))
    assert built["version"] == "v0001" and built["rows"]["parts"] > 0
    for strategy in ("by_position", "per_user"):
        done = jobs.split_build(spark, world("offline"), world(f"split-{strategy}"), strategy=strategy)
        assert done["rows"] == built["rows"]["parts"]
        train = spark.read.parquet(done["parts"]["train"])
        assert train.count() == done["train_rows"] and train.where("label <= 0 OR label >= 1").count() == 0
    sinks.training_export(train, world("shards"), 2)
    assert spark.read.parquet(world("shards")).count() == done["train_rows"]
    report = jobs.profile_report(spark.read.parquet(built["parts"]["parts"]), world("profile.json"), {"cosine_stats": False})
    assert report["overview"][0]["total_rows"] == built["rows"]["parts"] and "cosine_stats" not in report
    assert files.read_json(spark, world("profile.json"), {})["label_histogram"]
    with pytest.raises(ValueError):
        jobs.offline_build(spark, world("base"), world("items"), world("bad"), weights=(0.0, 0.0))


def test_online_chain(spark, world):
    assert jobs.online_build(spark, world("in"), world("vec"), world("items"), world("on"))["status"] == "no_input_versions"
    events = lambda *rows: spark.createDataFrame(list(rows), "event_id long, user_id long, movie_id long, watch_duration_seconds double").coalesce(1)
    vec = lambda *users: spark.createDataFrame([(u, "[" + ",".join([str(float(u))] * 16) + "]") for u in users], "user_id long, embedding string").coalesce(1)
    events((1, 1, 1, 10.0)).write.parquet(world("in/versions/20231201000000/user_events"))  # before any vectors
    events((2, 1, 1, 600.0), (3, 2, 2, 30.0), (4, 1, 99, 5.0)).write.parquet(world("in/versions/20240105000000/user_events"))
    vec(1).write.parquet(world("vec/versions/2024-01-01-00-00"))
    first = jobs.online_build(spark, world("in"), world("vec"), world("items"), world("on"))
    rows = spark.read.parquet(first["parts"]["parts"]).collect()
    assert [(r["event_id"], r["version_time"], r["label"]) for r in rows] == [(2, datetime(2024, 1, 1), 600.0)]
    assert jobs.online_build(spark, world("in"), world("vec"), world("items"), world("on"))["status"] == "already_up_to_date"
    vec(1, 2).write.parquet(world("vec/versions/2024-01-06-00-00"))
    events((5, 2, 3, 60.0)).write.parquet(world("in/versions/240107000000/user_events"))
    second = jobs.online_build(spark, world("in"), world("vec"), world("items"), world("on"))
    assert second["version"] == "v0002" and second["input_versions"] == ["240107000000"]
    assert [r["event_id"] for r in spark.read.parquet(second["parts"]["parts"]).collect()] == [5]
    assert VersionedDataset(spark, world("on")).registry()["latest_processed_input"] == "240107000000"
    spark.range(1).write.json(world("in/versions/20240108000000/other"))  # a version without events
    assert jobs.online_build(spark, world("in"), world("vec"), world("items"), world("on")) == {"status": "ok", "version": None}
    assert VersionedDataset(spark, world("on")).registry()["latest_processed_input"] == "20240108000000"
    done = jobs.split_build(spark, world("on"), world("on-split"), kind="online")
    assert done["rows"] == 1


def test_sql_name(spark):
    import hashlib

    register(spark)
    got = spark.sql("SELECT blake2b_share('1:2') AS x").first()["x"]
    assert got == int.from_bytes(hashlib.blake2b(b"1:2", digest_size=8).digest(), "big") / (2**64 - 1)
