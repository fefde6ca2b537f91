"""Ordering helpers against brute force, with one key that holds a third of all rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import ordering


def skewed(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 7 if i % 3 == 0 else rnd.randrange(40)
        # a third of the times are equal, too
        ts = 500 if rnd.random() < 0.33 else rnd.randrange(1000)
        rows.append((user, ts, i, rnd.randrange(5)))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed(), "user long, ts long, id long, x long").cache()


def expected(rows, with_key=True):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0] if with_key else 0].append(r)
    out = {}
    for key, members in groups.items():
        total = 0
        for i, r in enumerate(sorted(members, key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            out[r[2]] = (i, len(members), total)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 100, 5])
def test_number_rows_by_key(table, hot_rows):
    got = ordering.number_rows(table, ["user"], ["ts", "id"], "seq", "n", hot_rows).collect()
    want = expected(skewed())
    assert {r["id"]: (r["seq"], r["n"]) for r in got} == {k: v[:2] for k, v in want.items()}


def test_number_rows_over_all(table):
    got = ordering.number_rows(table, [], ["ts", "id"], "seq", "n").collect()
    assert {r["id"]: (r["seq"], r["n"]) for r in got} == {
        k: v[:2] for k, v in expected(skewed(), False).items()
    }


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_running_sum(table, hot_rows):
    got = ordering.running(table, ["user"], ["ts", "id"], {"s": F.col("x")}, None, hot_rows).collect()
    assert {r["id"]: r["s"] for r in got} == {k: v[2] for k, v in expected(skewed()).items()}


def test_null_keys_stay_one_group(spark):
    df = spark.createDataFrame([(None, i, i, 0) for i in range(20)] + [(1, i, 100 + i, 0) for i in range(20)],
                               "user long, ts long, id long, x long")
    got = ordering.number_rows(df, ["user"], ["ts", "id"], "seq", "n", 5).collect()
    assert sorted(r["seq"] for r in got if r["user"] is None) == list(range(1, 21))
    assert {r["n"] for r in got} == {20}


def test_hot_key_is_spread_over_tasks(table):
    hot = table.where("user = 7").withColumn("on", F.lit(True))
    cut, names = ordering.range_buckets(hot, ["ts", "id"], 8)
    sizes = [r["count"] for r in cut.groupBy(*names).count().collect()]
    assert len(sizes) >= 6
    assert max(sizes) <= 0.4 * sum(sizes)


def test_range_buckets_never_decrease(table):
    cut, names = ordering.range_buckets(table, ["ts", "id"], 8)
    rows = sorted(cut.collect(), key=lambda r: (r["ts"], r["id"]))
    marks = [tuple(r[n] for n in names) for r in rows]
    assert marks == sorted(marks)


@pytest.mark.parametrize("chunk", [10, 17, 1000])
def test_sliding(table, chunk):
    placed = ordering.number_rows(table, ["user"], ["ts", "id"], "seq")
    got = ordering.sliding(placed, ["user"], "seq", 10, {"s": F.sum("x"), "c": F.count(F.lit(1))}, chunk).collect()
    groups = defaultdict(list)
    for r in sorted(skewed(), key=lambda r: (r[1], r[2])):
        groups[r[0]].append(r)
    want = {}
    for members in groups.values():
        for i, r in enumerate(members):
            frame = members[max(0, i - 9) : i + 1]
            want[r[2]] = (sum(f[3] for f in frame), len(frame))
    assert {r["id"]: (r["s"], r["c"]) for r in got} == want


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_exact_quantiles(table, hot_rows):
    probs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r["user"]: r for r in ordering.exact_quantiles(table, "ts", probs, ["user"], hot_rows).collect()}
    groups = defaultdict(list)
    for r in skewed():
        groups[r[0]].append(r[1])
    assert set(got) == set(groups)
    for user, values in groups.items():
        for name, p in probs.items():
            assert got[user][name] == pytest.approx(np.quantile(values, p))


def test_exact_quantiles_without_key(table):
    got = ordering.exact_quantiles(table, "ts", {"m": 0.5, "p": 0.99}).first()
    values = [r[1] for r in skewed()]
    assert got["m"] == pytest.approx(np.quantile(values, 0.5))
    assert got["p"] == pytest.approx(np.quantile(values, 0.99))


BIG = 2**60


@pytest.mark.parametrize("kind", ["large", "text", "decimal", "time"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
@pytest.mark.parametrize("with_key", [True, False])
def test_orders_beyond_doubles(spark, kind, hot_rows, with_key):
    """Same positions below and above the threshold for orders that a double cannot hold."""
    n = 2000
    first = {
        "large": F.lit(BIG) + F.col("id"),
        "text": F.concat(F.lit('a"\u00e9 '), F.lpad(F.col("id").cast("string"), 6, "0")),
        "decimal": (F.col("id").cast("decimal(38,10)") + F.lit(2).cast("decimal(38,10)") / 10_000_000),
        "time": F.timestamp_micros(F.lit(10**15) + F.col("id")),
    }[kind]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(n).select(F.lit(1).alias("k"), first.alias("o"), (-F.col("id")).alias("p"), "id")
        df = df.repartition(7, "id").withColumn("o", F.when(F.col("id") % 50 != 0, F.col("o")))
        got = ordering.number_rows(df, ["k"] if with_key else [], ["o", "p"], "seq", "n", hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    nulls = sorted((i for i in range(0, n, 50)), reverse=True)
    want = nulls + [i for i in range(n) if i % 50]
    assert [r["id"] for r in sorted(got, key=lambda r: r["seq"])] == want
    assert {r["seq"] for r in got} == set(range(1, n + 1)) and {r["n"] for r in got} == {n}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_join_per_key(table, how, hot_rows):
    stats = table.where("user <> 3").groupBy("user").agg(F.max("ts").alias("last"))
    got = ordering.join_per_key(table, stats, ["user"], ["id"], how, hot_rows)
    want = table.join(stats, "user", how)
    columns = ["id", "user", "ts", "x", "last"]
    assert sorted(got.select(*columns).collect(), key=str) == sorted(want.select(*columns).collect(), key=str)
