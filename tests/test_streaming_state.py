"""Streams with event time: alerts, gates, completion, retention, and states that fall."""

import random

import pytest
from pyspark.sql import functions as F

from shotspark.operators import delivery, metrics
from shotspark.streaming import operators as stream

DAY = 86_400


def feed(spark, tmp_path, batches, schema, name="in"):
    """A stream that gives one list of rows per micro-batch; ``s`` becomes the timestamp ``ts``."""
    source = str(tmp_path / name)
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)


def run(spark, tmp_path, df, name="out"):
    query = (
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    states = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    return spark.read.schema(df.schema).parquet(str(tmp_path / name)), states


def shuffled(rows, parts, reach, draw):
    """Rows in event order, moved by at most ``reach`` seconds, in ``parts`` batches."""
    rows = sorted(rows, key=lambda r: r[-1] + draw.random() * reach)
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_alerts_equal_the_batch_periods(spark, tmp_path):
    draw, rows = random.Random(1), []
    for series, high in (("backend_up", 0.0), ("gpu_temperature", 90.0), ("memory_used_ratio", 0.95)):
        s, on = 0, False
        while s < 6_000:
            on = not on if draw.random() < 0.06 else on
            rows.append((series, len(rows), high if on else high + 1 if series == "backend_up" else 0.1, s))
            s += draw.randrange(5, 25)
        rows.append((series, len(rows), 1.0 if series == "backend_up" else 0.0, s))
    rows.append(("nobody_watches", len(rows), 0.0, 7_000))
    late = [*shuffled(rows, 5, 20, draw), [("redis_up", 10**6, 1.0, 90_000)], [("redis_up", 10**6 + 1, 1.0, 90_001)]]
    schema = "series string, event_id bigint, value double, s bigint"
    got, states = run(spark, tmp_path, stream.evaluate_alerts_stream(feed(spark, tmp_path, late, schema), delay="30 seconds"))
    samples = spark.createDataFrame(rows, schema).withColumn("us", F.col("s") * 1_000_000)
    want = {tuple(r) for r in metrics.evaluate_alerts(samples).select("alert", "since_us", "until_us").collect()}
    told = got.collect()
    assert {(r.alert, r.since_us, r.until_us) for r in told if r.state == "resolved"} == want and len(want) > 5
    assert {(r.alert, r.since_us) for r in told if r.state == "firing"} == {(a, s) for a, s, _ in want}
    pending = {(r.alert, r.since_us) for r in told if r.state == "pending"}
    assert pending == {(r.alert, r.since_us) for r in told if r.state in ("resolved", "cleared")}


def test_gate_waits_for_cut_results(spark, tmp_path):
    draw = random.Random(2)
    cuts = [(t, c, 100 * c + draw.randrange(-50, 50) + 200) for t in range(3) for c in range(12) if (t + c) % 4]
    results = [(t, c, 100 * c + 200) for t in range(3) for c in range(12)]
    tail = [(9, 0, 10**6), (9, 1, 10**6 + 50)]
    schema = "task_id bigint, chunk_index bigint, s bigint"
    a = feed(spark, tmp_path, [*shuffled(results + results[:5], 4, 5, draw), *[[t] for t in tail]], schema, "tracking").drop("s")
    b = feed(spark, tmp_path, [*shuffled(cuts + cuts[:7], 3, 5, draw), *[[t] for t in tail]], schema, "cuts").drop("s")
    got, states = run(spark, tmp_path, stream.reject_unverified_stream(a, b, wait="60 seconds", keep="1 hours", delay="2000 seconds"))
    frame = lambda rows: spark.createDataFrame(rows, schema)
    good, bad = delivery.reject_unverified(frame(results), frame(cuts))
    want = {(r.task_id, r.chunk_index, True) for r in good.collect()} | {(r.task_id, r.chunk_index, False) for r in bad.collect()}
    found = [(r.task_id, r.chunk_index, r.accepted) for r in got.where("task_id < 9").collect()]
    assert set(found) == want and len(found) == len(want) and any(not x for *_, x in found)
    # Only the rows of the last moment are still held.
    assert max(states) > 40 and states[-1] < 12


@pytest.mark.parametrize("expire", [False, True])
def test_completion_from_both_sides(spark, tmp_path, expire):
    draw = random.Random(3)
    rows = [(t, c, draw.randrange(2_000)) for t in range(8) for c in range(6) if (t, c) != (5, 2)]
    totals = [(t, 0 if t == 6 else 6, draw.randrange(2_000)) for t in range(8)]
    tail = [(99, 0, 10**6), (99, 1, 10**6 + 10**5)]
    tracked = feed(spark, tmp_path, [*shuffled(rows * 2, 4, 300, draw), *[[t] for t in tail]], "task_id bigint, chunk_index bigint, s bigint", "a")
    planned = feed(spark, tmp_path, [*shuffled(totals, 3, 300, draw), *[[t] for t in tail]], "task_id bigint, total_chunks bigint, s bigint", "b")
    expiry = stream.Expiry("ts", "3000 seconds", DAY) if expire else None
    got, states = run(spark, tmp_path, stream.completed_tasks_stream(tracked, planned, expiry))
    batch = delivery.completed_tasks(
        spark.createDataFrame(rows, "task_id bigint, chunk_index bigint, s bigint"), spark.createDataFrame(totals, "task_id bigint, total_chunks bigint, s bigint")
    )
    found = [(r.task_id, r.completed, r.total_chunks) for r in got.where("task_id < 99").collect()]
    assert sorted(found) == sorted((r.task_id, r.completed, r.total_chunks) for r in batch.collect()) and len(found) == 6
    # Told tasks keep no chunks; with an expiry only the task of the last moment is left.
    assert states[-1] <= (4 if expire else 20) < max(states)


def test_retention_equals_the_batch_rule(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice("xyz"), n, s) for n, s in enumerate(sorted(draw.sample(range(40_000), 300)))]
    rows += [("idle", 1_000, 5), ("idle", 1_001, 6)]
    end = 80_000
    last = [("x", 2_000, end), ("w", 2_001, end)]
    live = feed(spark, tmp_path, [*shuffled(rows, 5, 8, draw), last, [("w", 2_002, end)]], "stream string, event_id bigint, s bigint")
    got, states = run(spark, tmp_path, stream.retain_stream(live, 15_000, 20, "10 seconds"))
    gone = {r.event_id: r.reason for r in got.collect()}
    all_rows = spark.createDataFrame(rows + last + [("w", 2_002, end)], "stream string, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    kept = {r.event_id for r in delivery.retain(all_rows, F.timestamp_seconds(F.lit(end - 10)), 15_000, 20).collect()}
    assert set(gone) == {r[1] for r in rows + last} - kept - {2_002}
    assert gone[1_000] == gone[1_001] == "age" and "length" in gone.values()
    # Streams that went silent hold nothing.
    assert states[-1] < max(states)


def test_silent_keys_are_forgotten(spark, tmp_path):
    """A chunk that never comes holds its video only until the video has been silent long enough."""
    waiting = [(t, c, 10 * c, c * 10 + t) for t in range(20) for c in range(1, 6)]
    rest = [[(99, 0, 0, 5 * DAY)], [(99, 1, 1, 5 * DAY + 60)], [(99, 2, 2, 5 * DAY + 120)]]
    schema = "task_id bigint, chunk_index bigint, arrived_us bigint, s bigint"
    live = feed(spark, tmp_path, [waiting, *rest], schema)
    got, states = run(spark, tmp_path, stream.contiguous_dispatch_stream(live, stream.Expiry("ts", "10 seconds", 2 * DAY)))
    assert {(r.task_id, r.chunk_index) for r in got.collect()} == {(99, 0), (99, 1), (99, 2)}
    assert max(states) >= 120 and states[-1] <= 5
    kept, states = run(spark, tmp_path, stream.contiguous_dispatch_stream(feed(spark, tmp_path, [waiting, *rest], schema, "again")), "kept")
    assert states[-1] >= 120 and kept.count() == 3


def test_other_states_fall_too(spark, tmp_path):
    tail = [[(99, 0, 5 * DAY)], [(99, 1, 5 * DAY + 60)], [(99, 2, 5 * DAY + 120)]]
    live = lambda name: feed(spark, tmp_path, [[(t, 0, t) for t in range(30)], *tail], "task_id bigint, chunk_index bigint, s bigint", name)
    expiry = stream.Expiry("ts", "10 seconds", DAY)
    us, event = F.unix_micros("ts").alias("us"), F.col("s").alias("event_id")
    none = F.array().cast("array<struct<start_frame: bigint, end_frame: bigint, confidence: double>>")
    forms = {
        "publish": lambda d: stream.ordered_publish_stream(d.select("task_id", "chunk_index", us, event, "ts"), expiry),
        "status": lambda d: stream.fold_status_stream(
            d.select("task_id", F.col("s").alias("seq"), "ts", F.lit("decoding").alias("stage"), F.lit(1.0).alias("progress")), expiry
        ),
        "gradual": lambda d: stream.own_gradual_stream(
            d.select(F.col("task_id").alias("video_id"), "chunk_index", F.lit(9).cast("bigint").alias("context_end"), F.lit(0).cast("bigint").alias("valid_start"),
                     F.lit(9).cast("bigint").alias("valid_end"), F.lit(False).alias("is_last"), none.alias("graduals"), "ts"), expiry
        ),
        "counter": lambda d: stream.counter_increments_stream(
            d.select(F.col("task_id").cast("string").alias("series"), us, event, F.col("chunk_index").alias("value"), "ts"), expiry
        ),
    }
    for name, form in forms.items():
        _, states = run(spark, tmp_path, form(live(name)), f"out-{name}")
        assert max(states) >= 60 and states[-1] <= 5, name
