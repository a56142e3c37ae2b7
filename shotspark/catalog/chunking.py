"""D: chunk plans over ``videos`` and the frames of ``frame_scores``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.fixtures import with_views
from shotspark.operators import chunks

QUERIES: dict = {}
ORACLE: dict = {}

#: The test videos are short, so their chunks are small: 16 frames with an overlap of 4.
SIZE, OVERLAP = 16, 4

PLAN_SQL = """
SELECT video_id, i AS chunk_index, greatest(0, i * 16 - 4) AS context_start,
    least(i * 16 + 16, frame_count) - 1 AS context_end, i * 16 AS valid_start,
    least(i * 16 + 16, frame_count) - 1 AS valid_end, least(i * 16 + 16, frame_count) = frame_count AS is_last,
    n AS total_chunks
FROM (SELECT video_id, frame_count, (frame_count + 15) // 16 AS n,
    unnest(range(0, (frame_count + 15) // 16)) AS i FROM videos) p"""


def small_videos(spark, d):
    return chunks.effective_chunking(fx.videos(spark, d), SIZE, OVERLAP, None)


def small_plan(spark, d):
    return chunks.plan_chunks(small_videos(spark, d))


def effective_chunking(spark, d):
    v = fx.videos(spark, d).withColumn("width", F.when(F.col("video_id") % 13 == 5, 0).otherwise(F.col("width")))
    return chunks.effective_chunking(v).select("video_id", "chunk_size", "overlap")


QUERIES["effective_chunking"] = effective_chunking
ORACLE["effective_chunking"] = with_views(
    """SELECT video_id, CASE WHEN m = 0 OR video_id % 13 = 5 THEN NULL WHEN m = 1 THEN 1 ELSE cs END AS chunk_size,
    CASE WHEN m = 0 OR video_id % 13 = 5 THEN NULL WHEN m = 1 THEN 0 ELSE least(ov, cs - 1) END AS overlap FROM (
    SELECT *, greatest(1, least(64, m - ov)) AS cs FROM (
    SELECT *, least(16, m // 4) AS ov FROM (
    SELECT video_id, CAST(83886080 // (width * height * 3) AS BIGINT) AS m FROM videos) a) b) c""",
    "videos",
)


def plan_chunks(spark, d):
    return small_plan(spark, d)


QUERIES["plan_chunks"] = plan_chunks
ORACLE["plan_chunks"] = with_views("SELECT * FROM plan", "videos", plan=PLAN_SQL)


def assign_frames_to_chunks(spark, d):
    frames = fx.frame_scores(spark, d).select("video_id", "frame")
    return chunks.assign_frames_to_chunks(frames, small_videos(spark, d))


QUERIES["assign_frames_to_chunks"] = assign_frames_to_chunks
ORACLE["assign_frames_to_chunks"] = with_views(
    """SELECT f.video_id, f.frame, p.chunk_index, f.frame - p.context_start AS local_frame FROM frame_scores f
    JOIN plan p ON f.video_id = p.video_id AND f.frame BETWEEN p.context_start AND p.context_end""",
    "frame_scores", "videos", plan=PLAN_SQL,
)


def _published(spark, d):
    a = fx.chunk_arrivals(spark, d)
    return a.select(F.col("task_id").alias("video_id"), "chunk_index").where("chunk_index % 3 <> 1")


def remaining_chunks(spark, d):
    return chunks.remaining_chunks(small_plan(spark, d), _published(spark, d)).select("video_id", "chunk_index", "valid_start")


QUERIES["remaining_chunks"] = remaining_chunks
ORACLE["remaining_chunks"] = with_views(
    """SELECT video_id, chunk_index, valid_start FROM plan p WHERE NOT EXISTS (SELECT 1 FROM chunk_arrivals a
    WHERE a.task_id = p.video_id AND a.chunk_index = p.chunk_index AND a.chunk_index % 3 <> 1)""",
    "videos", "chunk_arrivals", plan=PLAN_SQL,
)

WINDOWS_SQL = """
SELECT video_id, w AS window_no, w * 24 AS start_frame, least(w * 24 + 32, frame_count) - 1 AS end_frame FROM (
    SELECT video_id, frame_count, unnest(range(0, frame_count)) AS w FROM videos) q
WHERE w = 0 OR (w - 1) * 24 + 32 < frame_count"""


def plan_model_windows(spark, d):
    return chunks.plan_model_windows(fx.videos(spark, d), 32, 8)


QUERIES["plan_model_windows"] = plan_model_windows
ORACLE["plan_model_windows"] = with_views("SELECT * FROM windows", "videos", windows=WINDOWS_SQL)


def pad_windows(spark, d):
    return chunks.pad_windows(plan_model_windows(spark, d), 32)


QUERIES["pad_windows"] = pad_windows
ORACLE["pad_windows"] = with_views(
    """SELECT video_id, window_no, slot, least(start_frame + slot, end_frame) AS frame, start_frame + slot > end_frame AS is_padding
    FROM (SELECT *, unnest(range(0, 32)) AS slot FROM windows) q""",
    "videos", windows=WINDOWS_SQL,
)


def check_chunk_frames(spark, d):
    """Every tenth chunk of the plan claims one frame more than the tables hold."""
    frames = fx.frame_scores(spark, d).select("video_id", "frame")
    plan = small_plan(spark, d).withColumn("context_end", F.col("context_end") + F.when(F.col("chunk_index") % 10 == 3, 1).otherwise(0))
    return chunks.check_chunk_frames(chunks.assign_frames_to_chunks(frames, small_videos(spark, d)), plan)


QUERIES["check_chunk_frames"] = check_chunk_frames
ORACLE["check_chunk_frames"] = with_views(
    """SELECT video_id, chunk_index, n + CASE WHEN chunk_index % 10 = 3 THEN 1 ELSE 0 END AS expected, frames, chunk_index % 10 <> 3 AND frames = n AS complete FROM (
    SELECT p.video_id, p.chunk_index, context_end - context_start + 1 AS n, count(f.frame) AS frames FROM plan p LEFT JOIN frame_scores f
    ON f.video_id = p.video_id AND f.frame BETWEEN p.context_start AND p.context_end GROUP BY p.video_id, p.chunk_index, context_start, context_end) q""",
    "videos", "frame_scores", plan=PLAN_SQL,
)

from shotspark.catalog import coordinates  # noqa: E402

coordinates.ORACLE["local_to_global"] = with_views(
    """SELECT video_id, chunk_index, l AS local, CASE WHEN l >= 0 AND l < context_end - context_start + 1 THEN context_start + l END AS frame
    FROM (SELECT *, unnest([-1, 0, 7, 19]::BIGINT[]) AS l FROM plan) q""",
    "videos", plan=PLAN_SQL,
)
