"""Views that give the test tables the shapes this library works on.

``SQL`` holds each view as portable SQL for the oracle; the functions build the same rows on
Spark.  Where the SQL ranks all events of a user in one window, the Spark form ranks in
time blocks, because one user may hold a large share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotspark.operators.ordered import BLOCK, HOUR_US, micros, scan, with_halo
from shotspark.session import durable

SQL: dict[str, str] = {
    "frame_scores": """
WITH f0 AS (SELECT user_id AS video_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
    CAST(round(value * 100) AS BIGINT) AS v FROM events),
f1 AS (SELECT *, CAST(sum(v) OVER (PARTITION BY video_id ORDER BY frame
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS s FROM f0)
SELECT video_id, frame, CAST(v AS DOUBLE) / (v + 9000) AS boundary_p,
    CAST(s AS DOUBLE) / (s + 12000) AS transition_p FROM f1""",
    "videos": """
SELECT user_id AS video_id, count(*) AS frame_count,
    CASE user_id % 4 WHEN 0 THEN '24/1' WHEN 1 THEN '25/1' WHEN 2 THEN '30000/1001' ELSE '0/0' END AS avg_frame_rate,
    '30/1' AS r_frame_rate,
    CASE user_id % 3 WHEN 0 THEN 1280 WHEN 1 THEN 1920 ELSE 2560 END AS width,
    CASE user_id % 3 WHEN 0 THEN 720 WHEN 1 THEN 1080 ELSE 1440 END AS height
FROM events GROUP BY user_id""",
    "detections": """
SELECT l_orderkey % 20 AS video_id, CAST(floor(l_orderkey / 20) AS BIGINT) AS frame,
    CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS detector,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS det_idx,
    CAST((l_suppkey % 5) * 8 AS DOUBLE) AS x1, CAST((l_linenumber % 3) * 8 AS DOUBLE) AS y1,
    (l_suppkey % 5) * 8 + 40 + l_quantity AS x2, (l_linenumber % 3) * 8 + 40 + l_quantity AS y2,
    CAST(5 + CAST(round(l_extendedprice) AS BIGINT) % 95 AS DOUBLE) / 100 AS conf,
    concat('Class-', CAST(l_partkey % 4 AS STRING)) AS class_name
FROM lineitem""",
    "manifest": """
SELECT archive_id, doc_id AS ord, CASE doc_id % 10
    WHEN 0 THEN concat('cam/', source, '.mp4') WHEN 1 THEN concat('cam/', CAST(doc_id AS STRING), '.MKV')
    WHEN 2 THEN 'notes/readme.txt' WHEN 3 THEN concat('__MACOSX/', lang, '.mp4')
    WHEN 4 THEN CASE WHEN archive_id % 5 = 0 THEN concat('../', source, '.mp4') ELSE concat('b/', source, '.m4v') END
    WHEN 5 THEN concat('a/._', source, '.mov') WHEN 6 THEN concat('dir', CAST(doc_id AS STRING), '/')
    WHEN 7 THEN CASE WHEN archive_id % 5 = 1 THEN concat('C:/', source, '.avi') ELSE concat('c/', source, '.avi') END
    WHEN 8 THEN concat(lang, '.webm') ELSE '.mp4' END AS filename,
    n_chars AS file_size, CAST(1 + floor(n_chars / (1 + doc_id % 103)) AS BIGINT) AS compress_size,
    CASE WHEN doc_id % 397 = 0 THEN 1 ELSE 0 END AS flag_bits,
    CASE WHEN doc_id % 389 = 0 THEN 2717843456 ELSE 2175008768 END AS external_attr
FROM (SELECT *, CAST(floor(doc_id / 10) AS BIGINT) % 20 AS archive_id FROM documents) d""",
    "status_updates": """
SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'decoding'
    WHEN 'view' THEN 'cut_detection' WHEN 'click' THEN 'tracking' WHEN 'purchase' THEN ''
    ELSE CASE WHEN event_id % 40 = 0 THEN 'failed' ELSE 'queued' END END AS stage,
    CAST(CAST(round(value * 100) AS BIGINT) % 10000 AS DOUBLE) / 100 AS progress, event_id % 50 AS cut_completed
FROM events""",
    "frame_features": """
SELECT label AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding FROM embeddings""",
    "pixels": """
SELECT l_orderkey % 20 AS video_id, CAST(floor(l_orderkey / 20) AS BIGINT) AS frame, l_partkey % 256 AS r,
    (l_suppkey * 7) % 256 AS g, CAST(l_quantity * 5 AS BIGINT) % 256 AS b FROM lineitem""",
    "annotations": """
SELECT o_custkey AS video_id, o_orderkey, 100 + o_orderkey % 900 AS start_frame,
    100 + o_orderkey % 900 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 + o_orderkey % 17 END AS end_frame,
    1200 AS frame_num FROM orders""",
    "chunk_arrivals": """
SELECT task_id, chunk_index + CASE WHEN event_id % 61 = 0 THEN 1000000 ELSE 0 END AS chunk_index, arrived_at, event_id FROM (
    SELECT user_id AS task_id, ts AS arrived_at, event_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS BIGINT) AS chunk_index FROM events) q""",
    "metric_samples": """
SELECT event_type AS worker, ts, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 500 AS BIGINT) AS value FROM events""",
    "envelopes": """
SELECT event_id, event_type, '1' AS schema_version, concat('{"task_id":"', CAST(user_id AS STRING), '","props":', props, '}') AS payload,
    CASE WHEN event_id % 7 = 0 THEN CAST(user_id AS STRING) ELSE '' END AS task_id FROM events""",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """``WITH`` the named fixture views (and extra CTEs, in order) in front of ``body``."""
    parts = [f"{n} AS ({SQL[n]}\n)" for n in names] + [f"{n} AS ({sql}\n)" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(spark: SparkSession, sf_dir: str, view: str, source: str) -> DataFrame:
    text = SQL[view].replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(view):
    """Keep a ranked view as a written table for the session.

    Scores, features and arrivals are input tables of this library; ranking the events that
    stand in for them is not part of any query and is done once.
    """

    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, view.__name__)
        if key not in _STORED:
            _STORED[key] = durable(view(spark, sf_dir))
        return _STORED[key]

    load.__name__ = view.__name__
    return load


@_stored
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        micros(F.col("ts")).alias("us"),
        "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    f0 = scan(events, ["video_id"], F.col("us"), ["event_id"], width=24 * HOUR_US, rank="frame")
    w = Window.partitionBy("video_id", "block").orderBy("frame").rowsBetween(-3, 3)
    return (
        with_halo(f0.select("video_id", "frame", "v"), F.col("frame"), 3, BLOCK)
        .withColumn("s", F.sum("v").over(w))
        .where("is_home")
        .select(
            "video_id",
            "frame",
            (F.col("v").cast("double") / (F.col("v") + 9000)).alias("boundary_p"),
            (F.col("s").cast("double") / (F.col("s") + 12000)).alias("transition_p"),
        )
    )


def videos(spark, sf_dir):
    return _select(spark, sf_dir, "videos", "events")


def unranked_detections(spark, sf_dir):
    """The same rows, not written: who leaves ``det_idx`` out reads lineitem and moves nothing."""
    # One frame's boxes are ranked together; a frame is bounded by what a detector emits.
    return _select(spark, sf_dir, "detections", "lineitem")


@_stored
def detections(spark, sf_dir):
    return unranked_detections(spark, sf_dir)


def manifest(spark, sf_dir):
    return _select(spark, sf_dir, "manifest", "documents")


def status_updates(spark, sf_dir):
    return _select(spark, sf_dir, "status_updates", "events")


@_stored
def frame_features(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("video_id"), "vec_id", "embedding")
    ranks = scan(vectors.select("video_id", "vec_id"), ["video_id"], F.col("vec_id"), rank="frame")
    return vectors.join(ranks, ["video_id", "vec_id"]).select("video_id", "frame", "embedding")


def pixels(spark, sf_dir):
    return _select(spark, sf_dir, "pixels", "lineitem")


def annotations(spark, sf_dir):
    return _select(spark, sf_dir, "annotations", "orders")


@_stored
def chunk_arrivals(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("ts").alias("arrived_at"),
        "event_id",
        F.col("value").alias("value"),
        F.round(F.col("value") * 100).cast("bigint").alias("__cents"),
    )
    ranked = scan(events, ["task_id"], F.col("__cents"), ["value", "event_id"], width=4096, rank="chunk_index")
    # One chunk in sixty-one comes under a number far beyond its task and leaves a hole.
    far = F.when(F.col("event_id") % 61 == 0, 1_000_000).otherwise(0)
    return ranked.select("task_id", (F.col("chunk_index") + far).alias("chunk_index"), "arrived_at", "event_id")


@_stored
def metric_samples(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("worker"), "ts", "event_id", micros(F.col("ts")).alias("us")
    )
    ranked = scan(events, ["worker"], F.col("us"), ["event_id"], width=HOUR_US, rank="r")
    return ranked.select("worker", "ts", "event_id", ((F.col("r") + 1) % 500).alias("value"))


def envelopes(spark, sf_dir):
    return _select(spark, sf_dir, "envelopes", "events")
