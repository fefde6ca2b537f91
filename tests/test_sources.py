"""Readers, writers, versions and state tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import files, readers, sinks
from tidewheel.sources.versions import VersionedDataset


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_ratings(spark, tmp_path):
    path = put(tmp_path / "r.csv", " UserId ,MOVIEID,Rating,extra,timestamp\n1,2,3.5,x,100\n1,b,4,y,\n")
    df = readers.read_ratings(spark, path)
    assert df.columns == ["user_id", "movie_id", "rating", "timestamp"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3.5", "100"), ("1", "b", "4", None)]
    with pytest.raises(ValueError):
        readers.read_ratings(spark, put(tmp_path / "bad.csv", "userId,rating\n1,2\n"))


def test_read_items(spark, tmp_path):
    movies = readers.read_movies(spark, put(tmp_path / "m.csv", 'movieId,title,genres\n1,"A, ""B"" (1999)",X|Y\nx,bad,Z\n'))
    assert [tuple(r) for r in movies.collect()] == [(1, 'A, "B" (1999)', "X|Y")]
    links = readers.read_links(spark, put(tmp_path / "l.csv", "movieId,imdbId,tmdbId\n1,0114709,862.0\n2,5,\n"))
    assert [tuple(r) for r in links.collect()] == [(1, "0114709", 862), (2, "5", None)]
    tags = readers.read_tags(spark, put(tmp_path / "t.csv", "userId,movieId,tag,timestamp\n1,2,fun,3\n"))
    assert [tuple(r) for r in tags.collect()] == [(2, "fun")]
    header = ",".join(readers.DETAIL_COLUMNS)
    details = readers.read_details(spark, put(tmp_path / "d.csv", header + ',more\n7,T,O,"two\nlines, here",,,,en,,,,False,2000-01-01,z\n'))
    row = details.first()
    assert row["overview"] == "two\nlines, here" and row["id"] == 7 and details.columns == list(readers.DETAIL_COLUMNS)


def test_version_times(spark):
    df = spark.createDataFrame([("240102030405",), ("20240102030405",), ("24-01-02-03-04",), ("2024-01-02-03-04",), ("v0001",)], "n string")
    rows = df.select(readers.input_version_time("n"), readers.vector_version_time("n")).collect()
    t, m = datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4)
    assert [tuple(r) for r in rows] == [(t, None), (t, None), (None, m), (None, m), (None, None)]


def test_version_folders(spark, tmp_path):
    root = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 2, 5.0)], "user_id long, movie_id long, watch_duration_seconds double")
    for name in ("240102030405/user_event", "20240102040405/user_events", "notes/user_events"):
        df.coalesce(1).write.parquet(f"{root}/versions/{name}")
    found = readers.read_input_versions(spark, root)
    assert sorted(r["input_version"] for r in found.collect()) == ["20240102040405", "240102030405"]
    assert found.select("file_id").distinct().count() == 2

    vecs = str(tmp_path / "vec")
    rows = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "oops"), (1, "[3.0, 4.0]")], "user_id long, embedding string")
    rows.coalesce(1).write.parquet(f"{vecs}/versions/24-01-01-00-00")
    got = [tuple(r) for r in readers.read_vector_versions(spark, vecs).collect()]
    assert got == [(1, datetime(2024, 1, 1), [3.0, 4.0])]


def test_item_vector_names(spark, tmp_path):
    folder = tmp_path / "e"
    spark.createDataFrame([(1, [1.0])], "movieId int, vector array<float>").write.parquet(f"{folder}/movie_embeddings.parquet")
    df = readers.read_item_vectors(spark, str(folder))
    assert [(r["movie_id"], r["embedding"]) for r in df.collect()] == [(1, [1.0])] and "ingest_order" in df.columns
    with pytest.raises(FileNotFoundError):
        readers.read_item_vectors(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        readers.pick_column(df, ["x"])


def test_read_kinds_and_counts(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).write.parquet(path)
    spark.range(5).withColumn("x", F.lit(1)).write.mode("append").parquet(path)
    assert readers.read_kind(spark, path, "parts_prefix").count() == 15
    assert readers.read_parquet(spark, path, ["id", "x"], True).count() == 15
    assert readers.count_rows(readers.read_parquet(spark, path)) == 15
    assert readers.estimate_chunks(readers.read_parquet(spark, path), 4) == 4
    with pytest.raises(ValueError):
        readers.read_kind(spark, path, "other")


def test_versioned_dataset(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        data.latest_source()
    first = data.write({"parts": spark.range(10)}, info={"note": "a"})
    assert first["version"] == "v0001" and first["rows"] == {"parts": 10} and first["note"] == "a"
    second = data.write({"train": spark.range(3), "test": spark.range(2)}, rows_per_file=2)
    assert second["version"] == "v0002" and data.next_version() == "v0003"
    assert data.latest_source() == (f"{tmp_path}/d/versions/v0002/parts", "version_dir_fallback")
    assert data.read("train").count() == 3 and data.read("parts").count() == 10
    assert data.resolve("parts", "v0001").endswith("v0001/parts")
    with pytest.raises(FileNotFoundError):
        data.resolve("train", "v0001")
    with pytest.raises(FileNotFoundError):
        data.resolve("val")
    data.write({"parts": spark.range(4)}, version="v0001")  # again: replaced in place
    assert data.read("parts", "v0001").count() == 4
    assert [e["version"] for e in data.registry()["versions"]] == ["v0002", "v0001"]
    assert data.latest_source()[1] == "parts_prefix"


def test_registry_forms(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path))
    put(tmp_path / "registry" / "versions.json", json.dumps({"versions": ["v0007"], "latest": "v0007"}))
    assert data.next_version() == "v0008" and data.latest_source()[0].endswith("versions/v0007/parts")
    put(tmp_path / "registry" / "versions.json", "{broken")
    with pytest.raises(ValueError):
        data.next_version()
    put(tmp_path / "registry" / "versions.json", "[1]")
    with pytest.raises(ValueError):
        data.commit({"version": "v0001"})


def test_written_manifest_without_registry_entry_counts(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path))
    data.commit({"version": "v0001"})
    files.write_json(spark, f"{data.folder('v0002')}/manifest.json", {"version": "v0002", "latest_processed_input": "x"})
    spark.range(1).write.parquet(f"{data.folder('v0003')}/parts")  # died before its manifest
    assert data.next_version() == "v0003" and data.registry()["latest_processed_input"] == "x"
    data.commit({"version": data.next_version()})
    assert [e["version"] for e in data.registry()["versions"]] == ["v0001", "v0002", "v0003"]


def test_an_older_manifest_never_becomes_latest(spark, tmp_path):
    """The registry lists v0003; a manifest of v0002 that nobody listed must not take its place."""
    data = VersionedDataset(spark, str(tmp_path))
    listed = [{"version": "v0001"}, {"version": "v0003", "latest_processed_input": "new"}]
    put(tmp_path / "registry" / "version.json", json.dumps(
        {"versions": listed, "latest": "v0003", "latest_version": "v0003", "latest_processed_input": "new"}))
    put(tmp_path / "versions" / "v0002" / "manifest.json", json.dumps({"version": "v0002", "latest_processed_input": "old"}))
    found = data.registry()
    assert (found["latest"], found["latest_processed_input"]) == ("v0003", "new")
    assert {e["version"] for e in found["versions"]} == {"v0001", "v0002", "v0003"}
    assert data.latest_source()[0].endswith("versions/v0003/parts")
    data.commit({"version": "v0002", "latest_processed_input": "older"})  # a slow writer
    found = data.registry()
    assert (found["latest"], found["latest_processed_input"]) == ("v0003", "new")
    put(tmp_path / "versions" / "v0010" / "manifest.json", json.dumps({"version": "v0010", "latest_processed_input": "newest"}))
    put(tmp_path / "versions" / "v0009" / "manifest.json", json.dumps({"version": "v0009", "latest_processed_input": "newer"}))
    found = data.registry()
    assert (found["latest"], found["latest_processed_input"]) == ("v0010", "newest")


def test_two_writers_never_share_a_number(spark, tmp_path):
    a, b = (VersionedDataset(spark, str(tmp_path)) for _ in range(2))
    first, second = a.claim_version(), b.claim_version()
    assert (first, second) == ("v0001", "v0002")
    assert not files.create_new(spark, f"{a.folder(first)}/_claimed")
    b.commit({"version": second, "latest_processed_input": "b"})  # the later number is ready first
    a.commit({"version": first, "latest_processed_input": "a"})
    found = a.registry()
    assert found["latest"] == second and found["latest_processed_input"] == "b"
    assert {e["version"] for e in found["versions"]} == {first, second}
    assert files.read_json(spark, f"{tmp_path}/latest/manifest.json", {})["version"] == second


def test_build_that_died_leaves_its_number(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path))
    rows = spark.range(3)
    data.write({"parts": rows})
    dead = data.claim_version()
    rows.write.parquet(f"{data.folder(dead)}/parts")  # no manifest
    assert data.registry()["latest"] == "v0001" and data.latest_source()[0].endswith("v0001/parts")
    assert data.write({"parts": rows})["version"] == "v0003"
    assert data.registry()["latest"] == "v0003"


def test_all_versions_are_kept(spark, tmp_path):
    data = VersionedDataset(spark, str(tmp_path))
    put(tmp_path / "registry" / "version.json", json.dumps({"versions": [{"version": f"v{i:04d}"} for i in range(1, 251)], "latest": "v0250"}))
    data.commit({"version": data.next_version()})
    listed = data.registry()["versions"]
    assert len(listed) == 251 and listed[-1]["version"] == "v0251"


def split_rows(spark):
    rows = [(u, s, "train" if s < 8 else "test") for u in (1, 2, 3) for s in range(1, 11)]
    return spark.createDataFrame(rows, "user_id long, seq_order long, dataset_split string")


def test_split_writers(spark, tmp_path):
    df = split_rows(spark)
    sinks.write_splits(df, str(tmp_path / "s"))
    assert files.folders(spark, str(tmp_path / "s")) == ["dataset_split=test", "dataset_split=train"]
    import glob
    import pyarrow.parquet as pq

    for path in glob.glob(f"{tmp_path}/s/*/*.parquet"):
        t = pq.ParquetFile(path).read().to_pylist()
        assert t == sorted(t, key=lambda r: (r["user_id"], r["seq_order"]))
    sinks.write_splits(df, str(tmp_path / "s2"), rows_per_file=1, spread=5)  # a user over several files
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 30
    sinks.write_buckets(df, str(tmp_path / "b"), 4)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 30 and back.groupBy("user_id").agg(F.count_distinct("bucket").alias("n")).agg(F.max("n")).first()[0] == 1


def test_json_lines_and_stringify(spark, tmp_path):
    df = spark.createDataFrame([(1, "é <x>", [1, 2], {"b": 1, "a": 2})], "id long, t string, l array<int>, m map<string,int>")
    sinks.write_json_lines(df.select("id", "t"), str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"id": 1, "t": "é <x>"} and "é" in text
    row = sinks.stringify(df.withColumn("s", F.struct(F.lit(1).alias("z"), F.lit(2).alias("y")))).first()
    assert (row["l"], row["m"], row["s"], row["t"]) == ("[1,2]", '{"a":2,"b":1}', '{"y":2,"z":1}', "é <x>")


def test_append_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        assert sinks.append_table(spark.range(3), None, path) == path
    assert spark.read.parquet(path).count() == 6


def test_training_export(spark, tmp_path):
    df = spark.createDataFrame([(i, i, [1.0], [2.0], 0.5) for i in range(100)],
                               "user_id long, movie_id long, user_embedding array<float>, movie_embedding array<float>, label double")
    sinks.training_export(df, str(tmp_path / "x"), 4)
    parts = list((tmp_path / "x").glob("part-*.parquet"))
    assert len(parts) == 4
    rows = [r["user_id"] for r in spark.read.parquet(str(tmp_path / "x")).collect()]
    assert sorted(rows) == list(range(100)) and rows != sorted(rows)
    with pytest.raises(ValueError):
        sinks.training_export(df.drop("label"), str(tmp_path / "y"), 2)


def test_merge_days(spark, tmp_path):
    from datetime import date

    path = str(tmp_path / "t")
    d = [date(2024, 1, i) for i in range(1, 5)]
    rows = lambda *r: spark.createDataFrame(list(r), "k long, day date, n long, note string")
    state = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("k", "day", "n", "note").collect())
    names = lambda day: sorted(f.name for f in (tmp_path / "t" / f"day={day}").glob("*.parquet"))
    sinks.merge_days(rows((1, d[0], 1, "a"), (2, d[0], 5, "a"), (3, d[1], 7, "a")), path, ["k"], "day", 0, ["n"])
    untouched = names(d[1])
    sinks.merge_days(rows((1, d[0], 10, "b"), (4, d[2], 2, "b")), path, ["k"], "day", 1, ["n"])
    want = [(1, d[0], 11, "b"), (2, d[0], 5, "a"), (3, d[1], 7, "a"), (4, d[2], 2, "b")]
    assert state() == want and names(d[1]) == untouched
    sinks.merge_days(rows((1, d[0], 10, "b"), (4, d[2], 2, "b")), path, ["k"], "day", 1, ["n"])  # the same batch again
    assert state() == want
    # a batch that was committed for one of its two days only is finished by its repeat
    sinks.merge_days(rows((1, d[0], 100, "c")), path, ["k"], "day", 2, ["n"])
    sinks.merge_days(rows((1, d[0], 100, "c"), (3, d[1], 1, "c"), (9, d[3], 9, "c")), path, ["k"], "day", 2, ["n"])
    assert state() == [(1, d[0], 111, "c"), (2, d[0], 5, "a"), (3, d[1], 8, "c"), (4, d[2], 2, "b"), (9, d[3], 9, "c")]
    sinks.merge_days(rows((2, d[0], 50, "d")), path, ["k"], "day", 3)  # without sums rows are replaced
    assert (2, d[0], 50, "d") in state()
    sinks.merge_days(rows(), path, ["k"], "day", 4, ["n"])
    assert len(state()) == 5


def test_insert_absent_and_upsert(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    state = lambda path: sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    path = str(tmp_path / "first")
    sinks.insert_absent(rows((1, 10), (2, 20), (2, 25)), path, ["k"], 0, 4)
    sinks.insert_absent(rows((2, 9), (3, 30)), path, ["k"], 1, 4)
    sinks.insert_absent(rows((2, 9), (3, 30)), path, ["k"], 1, 4)  # the same batch again
    sinks.insert_absent(rows(), path, ["k"], 2, 4)
    assert state(path) == [(1, 10), (2, 20), (3, 30)]
    path = str(tmp_path / "last")
    sinks.upsert(rows((1, 10), (2, 20)), path, ["k"], 0, 4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "last").rglob("*.parquet")}
    sinks.upsert(rows((2, 5), (3, 30)), path, ["k"], 1, 4)
    assert state(path) == [(1, 10), (2, 5), (3, 30)]
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    touched = {r["bucket"] for r in spark.read.parquet(path).where("k in (2, 3)").collect()}
    assert all(int(p.parent.name.split("=")[1]) in touched for p in set(before) - set(kept))


def test_sketches_of_versions(spark, tmp_path):
    """Merged sketches against exact figures; a version added again replaces its row."""
    from tidewheel.operators import sketches

    root = str(tmp_path / "sketches")
    rows = spark.range(60_000).selectExpr("id", "id % 9000 as user", "cast((id * 7919) % 60000 as double) as value", "id % 3 as part")
    for part in (0, 1, 2, 1):
        sketches.add_version(rows.where(f"part = {part}").drop("part"), root, f"v{part}", ["user", "id"], ["value"])
    (got,) = sketches.overview(spark, root, {"p10": 0.1, "p50": 0.5}).collect()
    assert (got["versions"], got["rows"], got["least_value"], got["greatest_value"]) == (3, 60_000, 0.0, 59_999.0)
    assert abs(got["distinct_user"] - 9000) <= 180 and abs(got["distinct_id"] - 60_000) <= 1200
    assert abs(got["p10_value"] - 6000) <= 1200 and abs(got["p50_value"] - 30_000) <= 1200
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sketches" / "version=v0").glob("*.parquet")}
    sketches.add_version(rows.where("part = 0").selectExpr("id + 100000 as id", "user", "value"), root, "v3", ["user", "id"], ["value"])
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sketches" / "version=v0").glob("*.parquet")} == kept
    assert sketches.overview(spark, root, {}).first()["rows"] == 80_000


def test_batch_folders(spark, tmp_path):
    path = str(tmp_path / "c")
    assert sinks.last_batch_before(spark, path) is None
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    state = lambda: sorted(tuple(r) for r in sinks.newest_rows(spark, path, ["k"]).collect())
    sinks.write_batch(rows((1, 1), (2, 1)), path, 0)
    sinks.write_batch(rows((2, 2)), path, 1)
    sinks.write_batch(rows((2, 2)), path, 1)  # the same batch again
    assert state() == [(1, 1), (2, 2)]
    sinks.write_batch(rows((1, 3), (3, 3)), path, 10)
    assert state() == [(1, 3), (2, 2), (3, 3)]
    assert sinks.last_batch_before(spark, path).endswith("batch_id=10")
    assert sinks.last_batch_before(spark, path, 10).endswith("batch_id=1")


def test_offline_dataset_by_position(spark, folder):
    from tidewheel.plans import datasets
    from tidewheel.sources import tables

    found = datasets.offline_dataset(tables.ratings(spark, folder), tables.items(spark, folder))
    counts = {r["dataset_split"]: r["count"] for r in found.groupBy("dataset_split").count().collect()}
    n = sum(counts.values())
    assert counts["train"] == int(n * 0.7) and counts["train"] + counts["val"] == int(n * (0.7 + 0.1))
    with pytest.raises(ValueError):
        datasets.offline_dataset(tables.ratings(spark, folder), tables.items(spark, folder), strategy="x")


def test_split_files_sorts_no_paths(spark, tmp_path):
    """Rows are brought together by hashes of their file; the path of each row is not sorted along."""
    from pyspark.sql import functions as F

    from tidewheel.plans import source_queries

    day = F.lit("2024-01-01").cast("timestamp")
    lines = spark.range(60).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(5.0).alias("l_quantity"))
    orders = spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4).alias("o_custkey"), day.alias("o_orderdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = source_queries.split_files(spark, str(tmp_path))
    assert sum(r["rows"] for r in found.collect()) == 60 and sum(r["out_of_order"] for r in found.collect()) == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(file0" in plan
