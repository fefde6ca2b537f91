"""Retrieval, scoring and metrics against numpy and plain loops."""

import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import metrics, retrieval, scoring


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    items = rng.normal(size=(150, 8)).round(3)
    items[50:60] = items[40:50]  # exact copies: ties go to the smaller id
    users = rng.normal(size=(37, 8)).round(3)
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(items)], "movie_id long, movie_embedding array<double>")
    u = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(users)], "user_id long, user_embedding array<double>")
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    scores = unit(users) @ unit(items).T
    want = {}
    for k in range(len(users)):
        order = sorted(range(len(items)), key=lambda j: (-round(scores[k, j], 12), j))[:12]
        want[k] = [(j, round(scores[k, j], 9)) for j in order]
    return u, i, want


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "tile_bytes": 2_000, "chunk_bytes": 500},
                                     {"max_broadcast_bytes": 0}])
def test_top_items(space, options):
    users, items, want = space
    got = defaultdict(list)
    for r in retrieval.top_items(users, items, 12, **options).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["movie_id"], r["score"]))
    assert set(got) == set(want)
    for k, rows in want.items():
        assert np.allclose([s for _, s in got[k]], [s for _, s in rows])
        # copies have equal scores up to the last bit, so compare ids where scores differ
        assert {j % 10 if 40 <= j < 60 else j for j, _ in got[k][:11]} == {j % 10 if 40 <= j < 60 else j for j, _ in rows[:11]}


def test_top_items_edges(spark, space):
    users, items, _ = space
    odd = spark.createDataFrame([(900, [1.0]), (901, None)], "user_id long, user_embedding array<double>")
    assert retrieval.top_items(odd, items, 5).count() == 0
    assert retrieval.top_items(users, items.where("movie_id < 0"), 5).count() == 0
    assert retrieval.top_items(users, items.where("movie_id < 3"), 5).count() == 37 * 3


def test_fallback_and_merge(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    found = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (3, 10, 0.5, 1)],
                                  "user_id long, movie_id long, score double, rank int")
    popular = spark.createDataFrame([(11, 50.0, 1), (12, 40.0, 2)], "movie_id long, score double, rank_position int")
    got = retrieval.with_popular_fallback(users, found, popular).collect()
    assert sorted((r["user_id"], r["movie_id"], r["rank"], r["category"]) for r in got) == [
        (1, 10, 1, "embedding"), (1, 11, 2, "embedding"), (2, 11, 1, "popular"), (2, 12, 2, "popular"),
    ]
    second = spark.createDataFrame([(1, 11, 50.0, 1), (1, 12, 40.0, 2)],
                                   "user_id long, movie_id long, score double, rank int")
    merged = retrieval.merge_candidates(found.where("user_id = 1"), second, 3).orderBy("rank").collect()
    assert [(r["movie_id"], r["source"], r["rank"]) for r in merged] == [(10, 1, 1), (11, 1, 2), (12, 2, 3)]


def test_title_search(spark):
    df = spark.createDataFrame([(2, "The Matrix"), (1, "matrix reloaded"), (3, "Heat")], "movie_id long, title string")
    assert [r["movie_id"] for r in retrieval.search_titles(df, " MATRIX ").collect()] == [1, 2]
    assert retrieval.search_titles(df, " m ").count() == 0


def requests(spark):
    rng = np.random.default_rng(9)
    rows = []
    for q in range(4):
        items = [(str(100 + j), rng.normal(size=3).tolist()) for j in range(6)]
        rows.append((f"q{q}", 3, rng.normal(size=3).tolist(), items if q < 3 else []))
    return spark.createDataFrame(
        rows,
        "request_id string, request_k int, user_embedding array<double>, "
        "candidates array<struct<movie_id:string, movie_embedding:array<double>>>",
    )


def features(u, v):
    u, v = np.array(u), np.array(v)
    cos = u @ v / (np.linalg.norm(u) * np.linalg.norm(v) + 1e-8)
    return np.concatenate([u, v, [cos, u @ v, np.linalg.norm(u - v)]])


def test_answer_requests_with_a_network(spark):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(5, 9)), rng.normal(size=5)), (rng.normal(size=(1, 5)), rng.normal(size=1))]
    req = requests(spark)
    got = defaultdict(list)
    for r in scoring.answer_requests(req, lambda p: scoring.dense_scores(p, layers)).orderBy("request_id", "rank").collect():
        got[r["request_id"]].append((r["movie_id"], r["score"]))
    assert set(got) == {"q0", "q1", "q2"}  # no candidates, no answer rows
    for r in req.collect():
        if not r["candidates"]:
            continue
        scored = []
        for c in r["candidates"]:
            x = features(r["user_embedding"], c["movie_embedding"])
            x = np.maximum(layers[0][0] @ x + layers[0][1], 0)
            scored.append((float((layers[1][0] @ x + layers[1][1])[0]), c["movie_id"]))
        scored.sort(key=lambda s: (-s[0], s[1]))
        assert [m for m, _ in got[r["request_id"]]] == [m for _, m in scored[:3]]
        assert np.allclose([s for _, s in got[r["request_id"]]], [s for s, _ in scored[:3]], atol=1e-7)


def test_fallback_answers(spark):
    req = requests(spark)
    broken = lambda p: p.withColumn("score", F.when(F.col("request_id") == "q1", F.lit(None)).otherwise(F.lit(1.0)))
    rows = scoring.answer_requests(req, broken, ["a", "b"]).where("request_id = 'q1'").orderBy("rank").collect()
    assert [(r["movie_id"], r["score"], r["reason"]) for r in rows] == [
        ("a", 0.0, "fallback_inference_error"), ("b", 0.0, "fallback_inference_error"),
    ]
    every = scoring.answer_requests(req, broken, None, mode="fallback")
    assert {r["reason"] for r in every.collect()} == {"fallback_mode_enabled"}
    assert every.where("request_id = 'q0'").count() == 3


def test_curated_fallback(spark):
    items = spark.createDataFrame([(i,) for i in (1, 2, 858, 318, 50)], "movie_id long")
    assert [r["movie_id"] for r in scoring.curated_fallback(items, 4).orderBy("rank").collect()] == [318, 858, 50, 1]


def test_normalised_popular(spark):
    df = spark.createDataFrame([(1, 8.0), (2, 4.0), (3, 1.0)], "movie_id long, score double")
    assert [r["score"] for r in scoring.normalised_popular(df, 2).orderBy("rank").collect()] == [1.0, 0.5]
    zero = df.withColumn("score", F.lit(0.0))
    assert {r["score"] for r in scoring.normalised_popular(zero).collect()} == {0.0}


def test_enrich_and_origin(spark):
    results = spark.createDataFrame([("q", 1, 1, 0.3), ("q", 2, 2, 0.2)], "request_id string, movie_id long, rank int, score double")
    items = spark.createDataFrame([(1, "A", None)], "movie_id long, title string, genres string")
    rows = {r["movie_id"]: r for r in scoring.enrich(results, items).collect()}
    assert (rows[1]["title"], rows[1]["genres"], rows[2]["title"]) == ("A", "Unknown", "Movie 2")
    before = spark.createDataFrame([("q", 1, 7, 0.9)], "request_id string, movie_id long, rank int, score double")
    rows = {r["movie_id"]: r for r in scoring.with_candidate_rank(results, before).collect()}
    assert (rows[1]["candidate_rank"], rows[2]["candidate_rank"], rows[2]["candidate_score"]) == (7, 2, 0.0)


def test_fit_regressors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        u, v = rng.normal(size=3), rng.normal(size=3)
        rows.append((i, u.tolist(), v.tolist(), float(0.3 * (u @ v) + 0.1)))
    df = spark.createDataFrame(rows, "movie_id long, user_embedding array<double>, movie_embedding array<double>, label double")
    name, model, mse = scoring.fit_regressors(df.where("movie_id < 200"), df.where("movie_id >= 200"))
    assert name == "linear" and mse < 0.01
    scored = scoring.model_score(model)(df)
    assert metrics.mse(scored.withColumnRenamed("score", "pred_score")).first()["mse"] < 0.01


# ---- metrics -------------------------------------------------------------------------


def test_ranking_metrics(spark):
    rnd = random.Random(8)
    rows = [(1, 1, 3.0, 0.5)]  # one row only: skipped
    for user, n in ((2, 2), (3, 30), (4, 10), (5, 11)):
        for m in range(n):
            label = 0.0 if user == 4 else float(rnd.randrange(0, 6))
            rows.append((user, m, label, rnd.randrange(6) / 5))
    df = spark.createDataFrame(rows, "user_id long, movie_id long, label double, pred_score double")
    want = {}
    for user in (2, 3, 4, 5):
        mine = [r for r in rows if r[0] == user]
        p = sorted(mine, key=lambda r: (-r[3], r[1]))[:10]
        t = sorted(mine, key=lambda r: (-r[2], r[1]))[:10]
        dcg = sum(r[2] / math.log2(i + 2) for i, r in enumerate(p))
        idcg = sum(r[2] / math.log2(i + 2) for i, r in enumerate(t))
        want[user] = (
            1.0 if {r[1] for r in p} & {r[1] for r in t} else 0.0, dcg / idcg if idcg > 0 else 0.0, len(mine) > 10,
        )
    got = {r["user_id"]: (r["hit_rate"], r["ndcg"], r["many"]) for r in metrics.user_ranking(df).collect()}
    assert set(got) == set(want)
    for user in want:
        assert got[user] == pytest.approx(want[user])
    assert metrics.ranking_metrics(df.where("user_id = 1")).first()["hit_rate"] == 0.0


def test_histogram_quantile(spark):
    rnd = random.Random(6)
    values = [rnd.expovariate(2) for _ in range(500)] + [20.0] * 5 + [0.001, 0.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cumulative = metrics.histogram(df, "v", metrics.LATENCY_EDGES)
    got = {r["bin"]: r["cumulative"] for r in cumulative.collect()}
    edges = metrics.LATENCY_EDGES + [math.inf]
    assert got == {i: sum(v <= e for v in values) for i, e in enumerate(edges)}
    for q in (0.01, 0.5, 0.95, 0.999):
        rank, low, seen, want = q * len(values), 0.0, 0, None
        for i, e in enumerate(edges):
            if got[i] >= rank:
                want = low if math.isinf(e) else low + (e - low) * (rank - seen) / (got[i] - seen)
                break
            low, seen = e, got[i]
        assert metrics.histogram_quantile(cumulative, q).first()["quantile"] == pytest.approx(want)


def breaker_loop(rows, width, limit):
    out = {}
    state = defaultdict(lambda: [deque(maxlen=width), "model"])
    for env, ts, key, used, reset in sorted(rows, key=lambda r: (r[1], r[2])):
        if reset:
            state[env] = [deque(maxlen=width), "model"]
        recent, mode = state[env]
        recent.append(used)
        if len(recent) >= width and mode == "model" and sum(recent) / len(recent) > limit:
            state[env][1] = "fallback"
        out[key] = state[env][1]
    return out


@pytest.mark.parametrize("hot_rows,chunk", [(1_000_000, 100_000), (20, 11)])
def test_circuit_breaker(spark, hot_rows, chunk):
    rnd = random.Random(12)
    rows = [
        ("prod" if rnd.random() < 0.6 else "canary", rnd.randrange(200), i, rnd.random() < 0.3, rnd.random() < 0.01)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "env string, ts long, event_id long, fallback_used boolean, reset boolean")
    got = metrics.circuit_breaker(df, 10, 0.4, reset="reset", hot_rows=hot_rows, chunk=chunk).collect()
    assert {r["event_id"]: r["mode"] for r in got} == breaker_loop(rows, 10, 0.4)


def test_release_gate(spark):
    rows = [("staging", "fallback" if i < 1 else "model", 0.2) for i in range(10)]
    rows += [("canary", "model", 0.9) for _ in range(10)] + [("prod", "model", 0.1)]
    got = {r["env"]: r for r in metrics.release_gate(spark.createDataFrame(rows, "env string, mode string, latency_s double")).collect()}
    assert got["staging"]["decision"] == "promote"
    assert got["canary"]["p95_ms"] > 500 and got["canary"]["decision"] == "roll_back"
    assert got["prod"]["passed"] is None


def test_cosine_block_equals_the_expression(spark):
    from tidewheel.functions import vectors

    rows = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0], None), ([1.0, None], [1.0, 2.0]),
            ([1.0], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0]), ([-3.0, 4.0, 0.5], [1.0, -1.0, 2.0]), ([1e-200], [1e-200])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").repartition(2)
    got = df.select(vectors.cosine_block("a", "b").alias("got"), vectors.cosine("a", "b", "null").alias("want")).collect()
    for r in got:
        assert (r["got"] is None) == (r["want"] is None)
        assert r["got"] is None or r["got"] == pytest.approx(r["want"], rel=1e-12, nan_ok=True)
    single = df.select(F.col("a").cast("array<float>"), "b").where("false")
    assert single.select(vectors.cosine_block("a", "b")).collect() == []


def clustered(spark, n, dim=8, seed=3):
    import random

    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [c + draw.gauss(0, 0.4) for c in centres[i % 12]]) for i in range(n)]


def test_index_finds_what_exact_search_finds(spark, monkeypatch):
    from tidewheel.operators import index

    items = spark.createDataFrame(clustered(spark, 900) + [(9001, None), (9002, [0.0] * 8), (9003, [1.0])], "movie_id long, movie_embedding array<double>")
    users = spark.createDataFrame(clustered(spark, 400, seed=9) + [(9004, None)], "user_id long, user_embedding array<double>")
    found = index.build(items)
    assert found.items.count() == 900 and len(found.centroids) == 30
    probes, recall = index.measured_probes(users.where("user_embedding is not null"), items, found, 10, 0.95, every=10)
    assert recall >= 0.95 and probes <= 16
    every = lambda df: {(r["user_id"], r["movie_id"], round(r["score"], 9), r["rank"]) for r in df.collect()}
    real = items.where("movie_id < 9000")
    exact = every(retrieval.top_items(users, real, 10))
    assert every(index.search(users.where("user_embedding is not null"), found, 10, 30)) == exact  # all cells: exact
    some = every(index.search(users.where("user_embedding is not null"), found, 10, probes, tile_rows=7, chunk_rows=11))  # crowded cells are cut
    assert some == every(index.search(users.where("user_embedding is not null"), found, 10, probes))
    assert len({x[:2] for x in some} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    none = index.build(items.where("false"))
    assert index.search(users, none, 10).collect() == []
    one = index.build(real.limit(1))
    assert index.search(users.where("user_id = 1"), one, 10).count() == 1


def test_fit_and_judge(spark, tmp_path):
    import random

    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression

    draw = random.Random(5)
    rows = []
    for i in range(600):
        x, noise = draw.random(), draw.random()
        part = "train" if i % 3 == 0 else "val" if i % 3 == 1 else "test"
        rows.append((i % 40, i, 0.5 * x + 0.1 + 0.01 * noise, part, x, noise))
    df = spark.createDataFrame(rows, "user_id long, movie_id long, label double, dataset_split string, good double, bad double")
    plain = lambda: LinearRegression(solver="normal", featuresCol="features", labelCol="label")
    (row,) = scoring.fit_and_judge(df, {"bad": (["bad"], plain()), "good": (["good"], plain())}, str(tmp_path / "m")).collect()
    assert row["chosen"] == "good" and row["mse"] < 1e-4 and row["samples"] == 200 and row["ndcg"] > 0.99 and row["users"] == 40
    assert PipelineModel.load(str(tmp_path / "m" / "good")).stages[-1].coefficients[0] == pytest.approx(0.5, abs=0.01)


@pytest.mark.parametrize("blocks", [3, 4096])
def test_best_keeps_ties_by_id_in_any_order(blocks):
    """Items come in blocks in random order, many with equal scores, one without a number."""
    rnd = np.random.default_rng(3)
    queries, base = rnd.normal(size=(300, 4)), rnd.normal(size=(9, 4))
    items = base[rnd.integers(0, 9, 200)]
    items[17] = np.nan
    ids = rnd.permutation(200)
    best = retrieval.Best(queries, 7)
    for at in range(0, 200, 50):
        best.take(ids[at : at + 50], items[at : at + 50], columns=blocks)
    scores = np.round(queries @ items.T, retrieval.DIGITS)
    for row in range(300):
        want = sorted((-s, i) for s, i in zip(scores[row], ids) if s == s)[:7]
        assert [(-s, i) for s, i in zip(best.scores[row], best.items[row])] == want


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0}])
def test_top_items_deals_users_by_work(space, monkeypatch, options):
    """Users lying in one file are searched by several tasks, each with its users' final rows."""
    users, items, _ = space
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    found = retrieval.top_items(users.coalesce(1), items, 5, **options)
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [len({r["user_id"] for r in rows})]).collect() if n]
    assert len(sizes) > 1 and sum(sizes) == found.select("user_id").distinct().count()


def test_index_moves_a_user_once(space):
    """The rows shuffled for an indexed search do not grow with the number of probes."""
    from tidewheel.operators import index

    users, items, _ = space
    made = index.build(items, cells=6)
    plan = lambda probes: index.search(users, made, 5, probes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(1).count("Generate") == plan(6).count("Generate") == 1  # items per chunk of users; users are not repeated


def test_a_search_task_stays_bounded(space):
    """Pairs and users of a task at six times the tables of 1 GB, and enough tasks at 1 GB."""
    users, _, _ = space
    cores = users.sparkSession.sparkContext.defaultParallelism
    held = 16 * 1024 * 1024 // (65 * 8)
    for many, items in ((450_000, 615_384), (5_400_000, 615_384)):
        tasks = retrieval.task_count(users, many, items, held)
        assert many * items / tasks <= 10_000_000_000 and many / tasks <= held
    assert retrieval.task_count(users, 15_000, 102_564, held) >= min(5, 4 * cores)


def written(spark, folder):
    """Bytes of shuffle files below a folder."""
    import os

    return sum(os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(folder) for f in names if f.startswith("shuffle"))


def counted(items, users):
    """A search by small tiles and chunks, and what its plan repeats."""
    found = retrieval.top_items(users, items, 5, max_broadcast_bytes=0, tile_bytes=2_000, chunk_bytes=1_000)
    return found, found._jdf.queryExecution().optimizedPlan().toString().count("Generate")


def test_items_move_once_per_executor(space, monkeypatch):
    """Beyond a bound no item is repeated for a chunk of users, in both searches; equal rows."""
    from tidewheel.operators import index

    users, items, _ = space
    every = lambda df: sorted((r["user_id"], r["movie_id"], r["score"], r["rank"]) for r in df.collect())
    made = index.build(items, cells=6)
    few, again = counted(items, users)
    near = every(index.search(users, made, 5, 2, chunk_rows=11))
    assert again == 1 and made.tiles is None
    for module in (retrieval, index):
        monkeypatch.setattr(module, "SHUFFLED_BYTES", 0 if module is retrieval else 1_000)
    many, none = counted(items, users)
    assert none == 0 and every(many) == every(few)
    assert every(index.search(users, made, 5, 2, chunk_rows=11)) == near and len(made.tiles.shared) > 1


def test_single_products_choose_the_same_items():
    """Scores that differ beyond single precision, in blocks that are full of equal items too."""
    rnd = np.random.default_rng(4)
    queries = rnd.normal(size=(40, 16))
    base = rnd.normal(size=16)
    items = np.concatenate([np.tile(base, (300, 1)), base + 1e-9 * rnd.normal(size=(300, 16)), rnd.normal(size=(100, 16))])
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    ids = rnd.permutation(700)
    best = retrieval.Best(queries, 9)
    for at in range(0, 700, 350):
        best.take(ids[at : at + 350], items[at : at + 350], columns=128)
    scores = np.array([[np.round(q @ v, retrieval.DIGITS) for v in items] for q in queries])
    for row in range(40):
        want = np.sort(scores[row])[::-1][:9]
        assert np.allclose(best.scores[row], want, rtol=0, atol=2e-12)


def test_written_tables_leave_no_shuffle(spark):
    """What the making of a stored table shuffled is removed with the write; the setting comes back."""
    from tidewheel.session import SHUFFLE_CLEANUP, cut_lineage

    shared = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before = written(spark, folder)
    made = cut_lineage(shared)
    assert written(spark, folder) <= before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")
    assert made.count() == shared.count() == 100


def test_candidates_get_every_row_of_their_item(spark, monkeypatch):
    """As a join by item: an id that comes twice gives two, one without a row none; missing ids meet nothing."""
    monkeypatch.setattr(retrieval, "TILE_BYTES", 30)
    lists = spark.createDataFrame(
        [(1, [1.0], [(1, 10), (2, 11), (3, None)]), (2, [2.0], [(1, 12)]), (3, [3.0], []), (4, [4.0], [(1, 11), (2, 10)])],
        "user_id long, user_embedding array<float>, found array<struct<rank:int, movie_id:long>>",
    )
    items = spark.createDataFrame([(10, [1.5, 2.5]), (11, None), (10, [3.5]), (None, [9.0]), (13, [4.0])], "movie_id long, movie_embedding array<float>")
    made = retrieval.with_item_vectors(lists, items)
    assert made.columns == ["user_id", "user_embedding", "candidates"]
    got = {r["user_id"]: [tuple(c) for c in r["candidates"]] for r in made.collect()}
    assert {u: sorted(c, key=str) for u, c in got.items()} == {
        1: [(1, 10, [1.5, 2.5]), (1, 10, [3.5]), (2, 11, None)], 2: [], 3: [], 4: [(1, 11, None), (2, 10, [1.5, 2.5]), (2, 10, [3.5])],
    }
    assert [c[0] for c in got[4]] == [1, 2, 2]  # in the order of the list
    none = retrieval.with_item_vectors(lists, items.where("movie_id = 99")).collect()
    assert [r["candidates"] for r in none] == [[]] * 4


def test_answers_read_their_requests_once(spark):
    """Scores are stored narrow, so the vectors of requests are not made again to rank them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def limit(k):
        seen.add(1)
        return k

    req = requests(spark).withColumn("request_k", limit.asNondeterministic()("request_k"))
    found = scoring.answer_requests(req, lambda p: p.withColumn("score", F.element_at("movie_embedding", 1)), ["a"])
    made = seen.value
    assert found.count() == 9 and made >= 4  # three requests have candidates
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1  # the fallback list; candidates were taken apart before


def test_few_products_are_formed_in_double(monkeypatch):
    """Only pairs that may be among the best; a missing number in a block hides no other."""
    rnd = np.random.default_rng(8)
    queries, items = rnd.normal(size=(50, 16)), rnd.normal(size=(20_000, 16))
    items[::4096] = np.nan
    formed, plain = [], retrieval.Best._products

    def counted(self, mine, matrix, rows, cols):
        formed.append(len(rows))
        return plain(self, mine, matrix, rows, cols)

    monkeypatch.setattr(retrieval.Best, "_products", counted)
    best = retrieval.Best(queries, 10)
    best.take(np.arange(20_000), items)
    scores = np.where(np.isnan(items[:, 0]), -np.inf, np.round(queries @ items.T, retrieval.DIGITS))
    order = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert (best.items == order).all() and np.allclose(best.scores, np.take_along_axis(scores, order, 1), rtol=0, atol=2e-12)
    assert 500 <= sum(formed) <= 50 * 20_000 // 100
