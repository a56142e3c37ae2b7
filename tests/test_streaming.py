"""Streams give the rows of their batch forms on the same input."""

import pytest
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog import delivery as cat_delivery
from shotspark.catalog import scenes as cat_scenes
from shotspark.catalog import status as cat_status
from shotspark.catalog.chunking import small_plan
from shotspark.operators import delivery, metrics, ownership, status
from shotspark.operators.ordered import micros
from shotspark.sources.envelopes import read_envelopes
from shotspark.streaming import operators as stream


def replay(spark, tmp_path, df, transform, order, files=3):
    """Write ``df`` as ``files`` files in order, stream them one per micro-batch."""
    source, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    df = df.withColumn("__n", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy(order)))
    schema = df.drop("__n").schema
    df.cache()
    for n in range(1, files + 1):
        df.where(F.col("__n") == n).drop("__n").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        transform(live).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return spark.read.parquet(out)


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)


def some_tasks(df, col="task_id"):
    return df.where(F.col(col) < 8)


def test_publish_once(spark, sf, tmp_path):
    a = cat_delivery.arrivals(spark, sf)
    got = replay(spark, tmp_path, a, lambda s: stream.publish_once_stream(s, ["task_id", "chunk_index"]), "arrived_at")
    same(got.select("task_id", "chunk_index"), delivery.publish_once(a).select("task_id", "chunk_index"))


def test_contiguous_dispatch(spark, sf, tmp_path):
    a = some_tasks(cat_delivery.arrivals(spark, sf)).withColumn("arrived_us", micros(F.col("arrived_at")))
    got = replay(spark, tmp_path, a, stream.contiguous_dispatch_stream, "arrived_us")
    want = delivery.contiguous_dispatch(a.drop("arrived_us")).select(
        "task_id", "chunk_index", micros(F.col("arrived_at")).alias("arrived_us"), micros(F.col("dispatched_at")).alias("dispatched_us")
    )
    same(got, want)


def test_ordered_publish(spark, sf, tmp_path):
    a = some_tasks(cat_delivery.attempts(spark, sf)).withColumn("us", micros(F.col("arrived_at")))
    got = replay(spark, tmp_path, a, stream.ordered_publish_stream, "us")
    same(got, delivery.ordered_publish(a.drop("us")).select("task_id", "chunk_index", "event_id", "outcome"))


def test_fold_status(spark, sf, tmp_path):
    u = some_tasks(cat_status.rich_updates(spark, sf))
    got = replay(spark, tmp_path, u, stream.fold_status_stream, "seq")
    newest = got.groupBy("task_id").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    want = status.fold_status(u).withColumns(
        {"processing_started_us": micros(F.col("processing_started_at")), "updated_us": micros(F.col("updated_at"))}
    ).drop("processing_started_at", "updated_at")
    want = want.withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
    same(newest.drop("seq", "tracking_completed"), want)


def test_own_gradual(spark, sf, tmp_path):
    found, plan = cat_scenes.global_detections(spark, sf), small_plan(spark, sf)
    g = found.where("type = 'gradual_transition'").groupBy("video_id", "chunk_index").agg(
        F.collect_list(F.struct("start_frame", "end_frame", "confidence")).alias("graduals")
    )
    messages = plan.join(g, ["video_id", "chunk_index"], "left")
    empty = F.array().cast(messages.schema["graduals"].dataType)
    messages = messages.withColumn("graduals", F.coalesce("graduals", empty)).withColumn("at", F.xxhash64("video_id", "chunk_index"))
    got = replay(spark, tmp_path, messages, stream.own_gradual_stream, "at")
    same(got, ownership.own_gradual(found, plan))


def test_stalled_tasks(spark, tmp_path):
    rows = [(1, 1, 0, "decoding"), (2, 2, 10, "tracking"), (1, 3, 50, "decoding"), (3, 4, 60, "completed"), (2, 5, 400, "tracking"), (4, 6, 1000, "queued")]
    df = spark.createDataFrame(rows, "task_id BIGINT, seq BIGINT, s BIGINT, stage STRING").select(
        "task_id", "seq", F.timestamp_seconds("s").alias("ts"), "stage"
    )
    got = replay(spark, tmp_path, df, lambda s: stream.stalled_tasks_stream(s, 120, "0 seconds"), "seq", files=6)
    assert sorted((r.task_id, r.last_us // 1_000_000) for r in got.collect()) == [(1, 50), (2, 10), (2, 400)]


def test_counter_increments(spark, sf, tmp_path):
    s = fx.metric_samples(spark, sf).select(F.col("worker").alias("series"), micros(F.col("ts")).alias("us"), "event_id", "value")
    got = replay(spark, tmp_path, s, stream.counter_increments_stream, "us")
    want = metrics.counter_increase(s, ["series"], 3 * 365 * 86_400)
    total = got.groupBy("series").agg(F.sum("increase").alias("increase"))
    same(total, want.groupBy("series").agg(F.max_by("increase", "us").alias("increase")))


def test_read_envelopes(spark, sf, tmp_path):
    e = fx.envelopes(spark, sf)
    parse = lambda s: read_envelopes(s.drop("task_id"), "task_id STRING, props STRUCT<k: BIGINT>", "view")
    same(replay(spark, tmp_path, e, parse, "event_id"), parse(e))
