"""Sinks that write once, and result documents read by folder."""

import json

import pytest
from pyspark.sql import functions as F

from shotspark.sources import files, results
from shotspark.streaming import sinks

ENVELOPE = "source_stream string, source_event_id string, event_type string, schema_version string, payload string"
SCHEMA = "task_id BIGINT, chunk_index BIGINT"


def envelopes(first, n):
    for i in range(first, first + n):
        payload = "{broken" if i % 7 == 3 else json.dumps({"task_id": i % 5} if i % 11 == 0 else {"task_id": i % 5, "chunk_index": i})
        yield ("cut", f"e{i}", "chunk" if i % 3 else "other", "1", None if i % 13 == 5 else payload)


def expected(rows):
    good, bad = set(), set()
    for _, event, kind, _, payload in rows:
        if kind != "chunk":
            continue
        try:
            value = json.loads(payload)
            good.add((event, value["task_id"], value["chunk_index"]))
        except (TypeError, ValueError, KeyError):
            bad.add((event, payload))
    return good, bad


def found(spark, path):
    rows, dead = sinks.delivered(spark, path)
    return (
        [(r.source_event_id, r.task_id, r.chunk_index) for r in rows.collect()],
        [(r.source_event_id, r.payload) for r in dead.collect()],
    )


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    path, rows = str(tmp_path / "out"), list(envelopes(0, 60))
    write = sinks.batch_writer(path, SCHEMA, worker="cut", event_type="chunk", required=["chunk_index"])
    df = spark.createDataFrame(rows, ENVELOPE)
    write(df, 0)
    write(df, 0)
    # A batch that broke off before its commit is not seen, and its second run replaces it.
    broken = spark.createDataFrame(rows[:5], ENVELOPE)
    broken.select("source_stream", "source_event_id", "event_type", F.lit(1).cast("bigint").alias("task_id"), F.lit(1).cast("bigint").alias("chunk_index")).write.parquet(f"{path}/rows/batch=1")
    good, bad = found(spark, path)
    want = expected(rows)
    assert (set(good), set(bad)) == want and len(good) == len(want[0]) and len(bad) == len(want[1]) and want[1]
    more = list(envelopes(60, 40))
    write(spark.createDataFrame(more, ENVELOPE), 1)
    good, bad = found(spark, path)
    want = expected(rows + more)
    assert (sorted(good), sorted(bad, key=str)) == (sorted(want[0]), sorted(want[1], key=str))


def test_a_stream_that_fails_and_starts_again(spark, tmp_path, monkeypatch):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    rows = list(envelopes(0, 90))
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], ENVELOPE).coalesce(1).write.mode("append").parquet(source)
    live = lambda: spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(source)
    real, calls = sinks.dead_letters, []

    def fails_once(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost between the two writes")
        return real(df)

    monkeypatch.setattr(sinks, "dead_letters", fails_once)
    start = lambda: sinks.deliver_once(live(), path, checkpoint, SCHEMA, worker="cut", event_type="chunk", required=["chunk_index"], available_now=True)
    with pytest.raises(Exception, match="lost between"):
        start().awaitTermination(120)
    assert start().awaitTermination(120)
    good, bad = found(spark, path)
    want = expected(rows)
    assert (sorted(good), sorted(bad, key=str)) == (sorted(want[0]), sorted(want[1], key=str))
    assert spark.read.parquet(f"{path}/commits").agg(F.sum("rows"), F.sum("dead_letters")).first()[:] == (len(good), len(bad))


def test_one_result_opens_one_folder(spark, tmp_path):
    path = str(tmp_path / "results")
    docs = spark.range(400).select(F.col("id").alias("video_id"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("part"), F.lit("x\ny").alias("text"))
    files.write_results(docs, path, buckets=64)
    for video in (0, 17, 399):
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(video).cast("bigint")), F.lit(64))).first()[0]
        assert results.bucket_of(video, 64) == bucket
    results.register_results(spark)
    stored = spark.read.format(results.FORMAT).option("buckets", 64).load(path)
    everything = {(r.video_id, r.part): r.document for r in stored.collect()}
    assert len(everything) == 800 and everything == {(r.video_id, r.part): r.document for r in files.read_result_documents(spark, path).collect()}
    one = stored.where("video_id = 17 and part = 1")
    assert [(r.video_id, r.part) for r in one.collect()] == [(17, 1)]
    some = stored.where(F.col("video_id").isin(3, 17, 9_999))
    assert {r.video_id for r in some.collect()} == {3, 17}
    assert stored.where("video_id = 5 and video_id = 6").count() == 0
    # Of 64 folders the reader lists the one that the id hashes to.
    reader = results.VideoResults({"path": path, "buckets": "64"}).reader(None)
    assert list(reader.pushFilters([results.EqualTo(("video_id",), 17)])) == [] and len(reader.folders()) == 1
    assert one.rdd.getNumPartitions() <= 8 < stored.rdd.getNumPartitions()
