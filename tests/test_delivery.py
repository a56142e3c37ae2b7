"""Delivery rules against plain folds, on odd rows and on large tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotspark.operators import delivery
from shotspark.operators.ordered import scan


def published(rows):
    """The sequential rule, attempt by attempt."""
    expected, out = {}, {}
    for task, chunk, us, event in sorted(rows, key=lambda r: (r[2], r[3])):
        want = expected.get(task, 0)
        if chunk is None:
            out[event] = "rejected"
            continue
        out[event] = "published" if chunk == want else "duplicate" if chunk < want else "rejected"
        expected[task] = want + (chunk == want)
    return out


def attempts(spark, rows):
    df = spark.createDataFrame(rows, "task_id string, chunk_index bigint, us bigint, event_id bigint")
    return df.select("task_id", "chunk_index", F.timestamp_micros("us").alias("arrived_at"), "event_id")


@pytest.mark.parametrize("block", [1, 2, 5, 4_096])
def test_publication_equals_the_fold(spark, block):
    draw, rows = random.Random(block), []
    for task in ("a", "b", None, "late", "none"):
        for n in range(150):
            chunk = draw.choice([None, -1, *range(20)]) if task != "late" else 30 + n % 3
            rows.append((task, int(n * 0.2) + draw.randrange(3) if task == "b" else chunk, draw.randrange(60), len(rows)))
    rows = [r for r in rows if r[0] != "none" or r[1] != 0]
    got = {r.event_id: r.outcome for r in delivery.ordered_publish(attempts(spark, rows), block=block).collect()}
    assert got == published(rows)
    assert set(got.values()) == {"published", "duplicate", "rejected"}
    assert delivery.ordered_publish(attempts(spark, rows).limit(0)).count() == 0


def test_a_task_of_five_million_attempts(spark):
    n, tries = 1_250_000, 4
    # Every chunk comes early, in time, late and once more; one in a hundred thousand is lost at first.
    k = F.col("id") % tries
    chunk = F.floor(F.col("id") / tries)
    shift = F.when(k == 0, -(chunk * 7 % 23)).when(k == 1, 0).when(k == 2, 3).otherwise(40)
    lost = (k == 1) & (chunk % 100_000 == 99_999)
    us = (chunk + shift) * 10 + k + F.when(lost, 300).otherwise(0)
    rows = spark.range(n * tries).select(
        F.lit(1).cast("bigint").alias("task_id"), chunk.alias("chunk_index"), F.timestamp_micros(us).alias("arrived_at"), F.col("id").alias("event_id")
    )
    got = delivery.ordered_publish(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("event_id") % 1000).alias("h"))
    ids = np.arange(n * tries)
    c, kk = ids // tries, ids % tries
    at = (c + np.where(kk == 0, -(c * 7 % 23), np.array([0, 0, 3, 40])[kk])) * 10 + kk + np.where((kk == 1) & (c % 100_000 == 99_999), 300, 0)
    order = np.lexsort((ids, at))
    expected, outcome = 0, np.empty(len(ids), np.int8)
    for i, x in zip(order.tolist(), c[order].tolist()):
        step = x - expected
        outcome[i] = 0 if step == 0 else 1 if step < 0 else 2
        expected += step == 0
    names = ["published", "duplicate", "rejected"]
    want = spark.createDataFrame([(int(i), names[o]) for i, o in zip(ids[::1000], outcome[::1000])], "event_id bigint, want string")
    assert {r.outcome: r.n for r in got.collect()} == {name: int((outcome == v).sum()) for v, name in enumerate(names)}
    checked = delivery.ordered_publish(rows).join(F.broadcast(want), "event_id")
    assert checked.where("outcome <> want").isEmpty() and expected == n
    # Blocks are alike, so no task of any exchange holds much more than another.
    sizes = [r["count"] for r in rows.groupBy(F.floor(F.col("chunk_index") / delivery.PUBLISH_BLOCK)).count().collect()]
    assert max(sizes) <= 2 * np.median(sizes) and len(sizes) > 300


def test_a_million_blocks_under_one_key(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 5 + 3).alias("at"), (F.col("id") % 7).alias("v"))
    got = scan(rows, ["k"], F.col("at"), width=5, rank="n", sums={"s": F.col("v")}, maxes={"m": F.col("v")}, previous={"p": F.col("at")})
    whole, rest = F.expr("n div 7 * 21"), F.expr("n % 7")
    wrong = got.where((F.col("at") != F.col("n") * 5 + 3) | (F.col("s") != whole + rest * (rest + 1) / 2) | (F.col("m") != F.least(F.col("n"), F.lit(6))))
    assert got.count() == n and wrong.isEmpty()
    assert got.where(~F.col("p").eqNullSafe(F.when(F.col("n") > 0, F.col("at") - 5))).isEmpty()


def test_in_flight_overall_over_many_blocks(spark):
    n = 100_000
    rows = spark.range(n).select((F.col("id") % 3).alias("task_id"), (F.col("id") * 10).alias("us"), F.col("id").alias("event_id"))
    done = rows.withColumn("us", F.col("us") + 15)
    got = delivery.in_flight(rows, done, width=10)
    # Each chunk is open for one and a half steps: one or two at any time.
    assert got.count() == 2 * n and {r[0] for r in got.where("us > 20 and us < 900000").select("total_in_flight").distinct().collect()} == {1, 2}
    assert got.agg(F.max("active_tasks")).first()[0] == 2
