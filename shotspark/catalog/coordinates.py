"""C: frame-rate and coordinate functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.fixtures import with_views
from shotspark.functions import coords

QUERIES: dict = {}
ORACLE: dict = {}

#: ``videos`` with the rate parsed, for the oracle of every query that needs one.
RATED_SQL = """
SELECT *, CASE WHEN avg_frame_rate NOT IN ('', '0/0')
    THEN CAST(split_part(avg_frame_rate, '/', 1) AS DOUBLE) / CAST(split_part(avg_frame_rate, '/', 2) AS DOUBLE)
    ELSE CAST(split_part(r_frame_rate, '/', 1) AS DOUBLE) / CAST(split_part(r_frame_rate, '/', 2) AS DOUBLE) END AS fps
FROM videos"""


def rated_videos(spark, d):
    return fx.videos(spark, d).withColumn(
        "fps", coords.parse_fps(F.col("avg_frame_rate"), F.col("r_frame_rate"))
    )


def parse_fps(spark, d):
    return rated_videos(spark, d).select("video_id", "fps")


QUERIES["parse_fps"] = parse_fps
ORACLE["parse_fps"] = with_views("SELECT video_id, fps FROM rated", "videos", rated=RATED_SQL)


def frame_count_or(spark, d):
    v = rated_videos(spark, d)
    nb = F.when(F.col("video_id") % 5 == 0, F.lit("N/A")).when(F.col("video_id") % 5 == 1, F.lit("0")).otherwise(
        F.col("frame_count").cast("string")
    )
    return v.select(
        "video_id",
        coords.frame_count_or(nb, (F.col("frame_count") + 1).cast("string")).alias("frames"),
        coords.duration_or(
            F.when(F.col("video_id") % 3 == 0, F.lit("-1")).otherwise(F.lit(None)),
            F.when(F.col("video_id") % 2 == 0, F.lit("12.5")).otherwise(F.lit("bad")),
            F.col("frame_count"), F.col("fps"),
        ).alias("duration"),
    )


QUERIES["frame_count_or"] = frame_count_or
ORACLE["frame_count_or"] = with_views(
    """SELECT video_id, CASE WHEN video_id % 5 IN (0, 1) THEN frame_count + 1 ELSE frame_count END AS frames,
    CASE WHEN video_id % 2 = 0 THEN CAST(12.5 AS DOUBLE) ELSE CAST(frame_count AS DOUBLE) / fps END AS duration FROM rated""",
    "videos", rated=RATED_SQL,
)


def frame_to_ts(spark, d):
    v = rated_videos(spark, d).select("video_id", "fps")
    return (
        fx.frame_scores(spark, d)
        .select("video_id", "frame")
        .join(v, "video_id")
        .select("video_id", "frame", coords.frame_to_ts(F.col("frame"), F.col("fps")).alias("ts"))
    )


QUERIES["frame_to_ts"] = frame_to_ts
ORACLE["frame_to_ts"] = with_views(
    "SELECT s.video_id, s.frame, CAST(s.frame AS DOUBLE) / r.fps AS ts FROM frame_scores s JOIN rated r ON s.video_id = r.video_id",
    "frame_scores", "videos", rated=RATED_SQL,
)


def local_to_global(spark, d):
    from shotspark.catalog.chunking import small_plan

    plan = small_plan(spark, d)
    ctx = F.col("context_end") - F.col("context_start") + 1
    probes = plan.withColumn("local", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(7), F.lit(19))))
    return probes.select(
        "video_id", "chunk_index", F.col("local").cast("bigint").alias("local"),
        coords.local_to_global(F.col("context_start"), F.col("local"), ctx).alias("frame"),
    )


QUERIES["local_to_global"] = local_to_global


def resample_index_map(spark, d):
    v = rated_videos(spark, d).select(
        "video_id", "frame_count",
        F.when(F.col("video_id") % 4 == 0, 24).when(F.col("video_id") % 4 == 1, 25)
        .when(F.col("video_id") % 4 == 2, 30000).otherwise(30).cast("bigint").alias("fps_num"),
        F.when(F.col("video_id") % 4 == 2, 1001).otherwise(1).cast("bigint").alias("fps_den"),
    )
    return coords.resample_index_map(v, 25)


QUERIES["resample_index_map"] = resample_index_map
ORACLE["resample_index_map"] = with_views(
    """SELECT video_id, tick, (tick * num + 25 * den - 1) // (25 * den) AS frame FROM (
    SELECT video_id, frame_count, num, den, unnest(range(0, 2 * frame_count + 2)) AS tick FROM (
    SELECT video_id, frame_count, CASE video_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 30000 ELSE 30 END AS num,
        CASE WHEN video_id % 4 = 2 THEN 1001 ELSE 1 END AS den FROM videos)) t
    WHERE (tick * num + 25 * den - 1) // (25 * den) < frame_count""",
    "videos",
)


def rescale_annotations(spark, d):
    v = rated_videos(spark, d).select("video_id", "fps")
    return coords.rescale_annotations(fx.annotations(spark, d), v, 30.0)


QUERIES["rescale_annotations"] = rescale_annotations
ORACLE["rescale_annotations"] = with_views(
    """SELECT video_id, o_orderkey, least(s, n - 1) AS start_frame,
    least(CASE WHEN end_frame - start_frame = 1 THEN s + 1 WHEN e <= s THEN s + 2 ELSE e END, n) AS end_frame, n AS frame_num
    FROM (SELECT a.*, CAST(round_even(CAST(frame_num AS DOUBLE) * (30.0::DOUBLE / fps), 0) AS BIGINT) AS n,
        CAST(round_even(CAST(start_frame AS DOUBLE) * (30.0::DOUBLE / fps), 0) AS BIGINT) AS s,
        CAST(round_even(CAST(end_frame AS DOUBLE) * (30.0::DOUBLE / fps), 0) AS BIGINT) AS e
        FROM annotations a JOIN rated r ON a.video_id = r.video_id) q""",
    "annotations", "videos", rated=RATED_SQL,
)


def letterbox_geometry(spark, d):
    h2 = F.when(F.col("video_id") % 13 == 5, 0).otherwise(F.col("height") + F.col("video_id") % 400 - 200)
    v = fx.videos(spark, d).withColumn("h2", h2)
    pad = coords.letterbox_geometry(F.col("width"), F.col("h2"))
    return v.select("video_id", pad.alias("p")).select("video_id", "p.pad_x", "p.pad_y")


QUERIES["letterbox_geometry"] = letterbox_geometry
ORACLE["letterbox_geometry"] = with_views(
    """SELECT video_id,
    CASE WHEN h2 IS NULL THEN NULL WHEN CAST(width AS DOUBLE) / h2 < a THEN CAST(floor((CAST(floor(h2 * a) AS BIGINT) - width) / 2.0) AS BIGINT) ELSE 0 END AS pad_x,
    CASE WHEN h2 IS NULL THEN NULL WHEN CAST(width AS DOUBLE) / h2 > a THEN CAST(floor((CAST(floor(width / a) AS BIGINT) - h2) / 2.0) AS BIGINT) ELSE 0 END AS pad_y
    FROM (SELECT *, CASE WHEN video_id % 13 <> 5 THEN height + video_id % 400 - 200 END AS h2, CAST(48 AS DOUBLE) / 27 AS a FROM videos) q""",
    "videos",
)


def normalise_bbox(spark, d):
    from shotspark.functions import boxes

    clipped = boxes.clip_boxes(fx.detections(spark, d), F.lit(1280), F.lit(720))
    n = coords.normalise_bbox(*[F.col(c) for c in ("x", "y", "width", "height")], F.when(F.col("frame") % 13 != 5, 1280.0).otherwise(0.0), F.lit(720.0))
    return clipped.select("video_id", "frame", "det_idx", n.alias("n")).select("video_id", "frame", "det_idx", "n.*")


QUERIES["normalise_bbox"] = normalise_bbox
ORACLE["normalise_bbox"] = with_views(
    """SELECT video_id, frame, det_idx, CASE WHEN frame % 13 <> 5 THEN x1 / 1280.0::DOUBLE END AS x, y1 / 720.0::DOUBLE AS y,
    CASE WHEN frame % 13 <> 5 THEN (x2 - x1) / 1280.0::DOUBLE END AS w, (y2 - y1) / 720.0::DOUBLE AS h FROM detections""",
    "detections",
)


def chunk_ids(spark, d):
    a = fx.chunk_arrivals(spark, d)
    scene = coords.scene_id(F.col("task_id"), F.col("chunk_index"))
    return a.select(
        "event_id",
        coords.chunk_id(F.col("task_id"), F.col("chunk_index")).alias("chunk_id"),
        scene.alias("scene_id"),
        coords.scene_ordinal(scene).alias("ordinal"),
    )


QUERIES["chunk_id"] = chunk_ids
ORACLE["chunk_id"] = with_views(
    """SELECT event_id, concat(CAST(task_id AS VARCHAR), ':', lpad(CAST(chunk_index AS VARCHAR), 8, '0')) AS chunk_id,
    concat(CAST(task_id AS VARCHAR), ':scene:', CAST(chunk_index AS VARCHAR)) AS scene_id, chunk_index AS ordinal FROM chunk_arrivals""",
    "chunk_arrivals",
)


def canonical_chunk_key(spark, d):
    a = fx.chunk_arrivals(spark, d)
    given = F.when(F.col("event_id") % 2 == 0, coords.chunk_id(F.col("task_id"), F.col("chunk_index"))).otherwise(
        F.format_string("%08d", "chunk_index")
    )
    return a.select("event_id", coords.canonical_chunk_key(F.col("task_id"), given).alias("chunk_key"))


QUERIES["canonical_chunk_key"] = canonical_chunk_key
ORACLE["canonical_chunk_key"] = with_views(
    """SELECT event_id, concat(CAST(task_id AS VARCHAR), ':', lpad(CAST(chunk_index AS VARCHAR), 8, '0')) AS chunk_key FROM chunk_arrivals""",
    "chunk_arrivals",
)
