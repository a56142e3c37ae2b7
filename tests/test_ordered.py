"""The ordered primitives against brute force, with blocks far smaller than the data."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shotspark.operators.metrics import counter_increase
from shotspark.operators.blocks import whole_groups
from shotspark.operators.ordered import islands, locate, previous_dense, scan, with_halo

R = random.Random(7)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def series(spark):
    data = []
    for key in range(4):
        frames = sorted(R.sample(range(200), R.randint(1, 120)))
        data += [(key, f, R.randint(-9, 9)) for f in frames]
    return data, spark.createDataFrame(data, "k BIGINT, p BIGINT, v BIGINT")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan(series, width):
    data, df = series
    got = scan(
        df, ["k"], F.col("p"), width=width, rank="n", sums={"s": F.col("v")},
        maxes={"m": F.when(F.col("v") % 2 == 0, F.col("v"))}, previous={"pv": F.col("v"), "pp": F.col("p")},
    )
    want, state = [], {}
    for k, p, v in data:
        n, s, m, pv, pp = state.get(k, (0, 0, None, None, None))
        if v % 2 == 0:
            m = v if m is None else max(m, v)
        want.append((k, p, n, s + v, -99 if m is None else m, -99 if pv is None else pv, -99 if pp is None else pp))
        state[k] = (n + 1, s + v, m, v, p)
    filled = got.fillna(-99)
    assert rows_of(filled, "k", "p", "n", "s", "m", "pv", "pp") == sorted(want)


@pytest.mark.parametrize("width,gap", [(1, 0), (4, 2), (16, 5), (1000, 0)])
def test_islands(series, width, gap):
    data, df = series
    got = islands(df, ["k"], F.col("p"), F.col("p"), gap=gap, width=width, maxes={"m": F.col("v")}, sums={"s": F.lit(1)})
    want = []
    for k, p, v in data:
        if want and want[-1][0] == k and p - want[-1][2] - 1 <= gap:
            _, a, _, m, n = want.pop()
            want.append((k, a, p, max(m, v), n + 1))
        else:
            want.append((k, p, p, v, 1))
    assert rows_of(got, "k", "start", "end", "m", "s") == sorted(want)


def test_islands_of_long_intervals(spark):
    """Intervals that span many blocks still merge with the ones that follow."""
    data, end = [], 0
    for _ in range(60):
        start = end + R.randint(0, 6)
        end = start + R.choice([0, 1, 3, 50])
        data.append((1, start, end))
        end += 1
    got = islands(spark.createDataFrame(data, "k BIGINT, a BIGINT, b BIGINT"), ["k"], F.col("a"), F.col("b"), gap=2, width=4)
    want = []
    for k, a, b in data:
        if want and a - want[-1][2] - 1 <= 2:
            want[-1] = (k, want[-1][1], b)
        else:
            want.append((k, a, b))
    assert rows_of(got, "k", "start", "end") == want


@pytest.mark.parametrize("how", ["inner", "left", "anti"])
def test_locate(spark, how):
    ivs, end = [], 0
    for i in range(25):
        start = end + R.randint(0, 9)
        end = start + R.randint(0, 40)
        ivs.append((1, start, end, i))
        end += 1
    pts = [(k, R.randint(0, end + 20)) for k in (1, 2) for _ in range(80)]
    got = locate(
        spark.createDataFrame(pts, "k BIGINT, p BIGINT"), spark.createDataFrame(ivs, "k BIGINT, a BIGINT, b BIGINT, i BIGINT"),
        ["k"], "p", "a", "b", ["i"], how=how, width=8,
    )
    found = [(k, p, next((i for kk, a, b, i in ivs if kk == k and a <= p <= b), None)) for k, p in pts]
    if how == "anti":
        assert rows_of(got, "k", "p") == sorted((k, p) for k, p, i in found if i is None)
    else:
        want = sorted((k, p, -1 if i is None else i) for k, p, i in found if how == "left" or i is not None)
        assert rows_of(got.fillna(-1), "k", "p", "i") == want


def test_locate_after_start(spark):
    """With touching intervals a shared end belongs to the earlier one."""
    ivs = spark.createDataFrame([(1, 0.0, 1.5), (1, 1.5, 3.0), (1, 3.0, 9.25)], "k BIGINT, a DOUBLE, b DOUBLE")
    pts = spark.createDataFrame([(1, t) for t in (0.0, 0.5, 1.5, 1.6, 3.0, 9.25, 9.3)], "k BIGINT, t DOUBLE")
    got = locate(pts, ivs, ["k"], "t", "a", "b", how="left", width=1_000_000, axis=lambda c: F.floor(c * 1_000_000).cast("bigint"), after_start=True)
    assert rows_of(got.fillna(-1.0), "t", "a") == [(0.0, -1.0), (0.5, 0.0), (1.5, 0.0), (1.6, 1.5), (3.0, 1.5), (9.25, 3.0), (9.3, -1.0)]


def test_halo_gives_every_neighbour(series):
    _, df = series
    w = Window.partitionBy("k", "block").orderBy("p").rangeBetween(-5, 5)
    got = with_halo(df, F.col("p"), 5, 8).withColumn("s", F.sum("v").over(w)).where("is_home")
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("p").rangeBetween(-5, 5)))
    assert rows_of(got, "k", "p", "s") == rows_of(want, "k", "p", "s")


def test_previous_dense(spark):
    df = spark.createDataFrame([(k, i, k * 100 + i) for k in (1, 2) for i in range(9)], "k BIGINT, i BIGINT, v BIGINT")
    got = previous_dense(df, ["k"], "i", {"before": "v"}).fillna(-1)
    assert rows_of(got, "k", "i", "v", "before") == sorted((k, i, k * 100 + i, -1 if i == 0 else k * 100 + i - 1) for k in (1, 2) for i in range(9))


def test_null_keys_and_positions_stay(spark):
    rows = [("a", 1, 1.0), ("a", 9, 2.0), (None, 1, 5.0), (None, 12, 7.0), (None, None, 4.0), ("a", None, 3.0)]
    df = spark.createDataFrame(rows, "k string, p bigint, v double")
    got = scan(
        df, ["k"], F.col("p"), width=4, rank="r", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, previous={"b": F.col("v")}
    )
    want = {
        ("a", None): (0, 3.0, 3.0, None), ("a", 1): (1, 4.0, 3.0, 3.0), ("a", 9): (2, 6.0, 3.0, 1.0),
        (None, None): (0, 4.0, 4.0, None), (None, 1): (1, 9.0, 5.0, 4.0), (None, 12): (2, 16.0, 7.0, 5.0),
    }
    assert {(x.k, x.p): (x.r, x.s, x.m, x.b) for x in got.collect()} == want


def test_counters_with_missing_labels(spark):
    rows = [(None, 0, 1.0), (None, 10, 4.0), ("x", 0, 2.0), ("x", 10, 5.0)]
    df = spark.createDataFrame(rows, "worker string, s int, value double")
    samples = df.select("worker", (F.col("s") * 1_000_000).cast("bigint").alias("us"), F.col("s").alias("event_id"), "value")
    got = {(r.worker, r.event_id): r.increase for r in counter_increase(samples, ["worker"], 60).collect()}
    assert got == {(None, 0): 0.0, (None, 10): 3.0, ("x", 0): 0.0, ("x", 10): 3.0}


def test_tables_of_python_tasks_stay_small():
    """Many small groups in one partition: no table grows with the partition, none cuts a group."""
    key = np.repeat(np.arange(60_000), 5)
    batches = [pa.record_batch([pa.array(key[i : i + 10_000])], names=["k"]) for i in range(0, len(key), 10_000)]
    seen = [table["k"].to_numpy() for table, _ in whole_groups(iter(batches), ["k"])]
    assert max(map(len, seen)) <= 50_000
    assert (np.concatenate(seen) == key).all()
    assert all(a[-1] != b[0] for a, b in zip(seen, seen[1:]))
