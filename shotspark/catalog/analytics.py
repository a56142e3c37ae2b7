"""K: viewer queries over tracks made of ``detections`` and scenes of 45 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.admission import UNION_ROWS
from shotspark.catalog.tracking import BOX_SCENES, box_scenes
from shotspark.fixtures import with_views
from shotspark.operators import analytics as an
from shotspark.operators import tracking
from shotspark.session import durable

QUERIES: dict = {}
ORACLE: dict = {}

FPS = "CASE {v} % 3 WHEN 0 THEN CAST(24 AS DOUBLE) WHEN 1 THEN CAST(25 AS DOUBLE) ELSE CAST(30000 AS DOUBLE) / 1001 END"


def box_videos(spark, d):
    return fx.detections(spark, d).select("video_id").distinct().select(
        "video_id", F.expr(FPS.format(v="video_id")).alias("fps"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"),
        F.when(F.col("video_id") % 4 == 0, 31.5).when(F.col("video_id") % 4 == 1, 0.0).alias("duration_seconds"),
        F.when(F.col("video_id") % 8 == 2, 17.25).alias("player_duration"),
    )


def tracks(spark, d):
    placed = tracking.assign_scene(fx.detections(spark, d).where("conf >= 0.5"), box_scenes(spark, d))
    return placed.select(
        "video_id", "scene_no", "frame", ((F.col("det_idx") * 5 + F.col("frame")) % 23).alias("track_id"), "class_name",
        F.col("conf").alias("confidence"), F.col("x1").alias("x"), F.col("y1").alias("y"),
        (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"),
    )


VIEW = {
    "s": BOX_SCENES,
    "tracks": """
SELECT t.video_id, s.scene_no, frame, (det_idx * 5 + frame) % 23 AS track_id, class_name, conf AS confidence, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height
FROM detections t JOIN s ON s.video_id = t.video_id AND t.frame BETWEEN s.start_frame AND s.end_frame WHERE conf >= 0.5::DOUBLE""",
    "kf": f"""
SELECT video_id, scene_no, track_id, row_number() OVER (PARTITION BY video_id, scene_no, track_id ORDER BY frame) - 1 AS k, frame, CAST(frame AS DOUBLE) / {FPS.format(v='video_id')} AS t,
    x / 1280.0::DOUBLE AS x, y / 720.0::DOUBLE AS y, width / 1280.0::DOUBLE AS w, height / 720.0::DOUBLE AS h, confidence, class_name FROM tracks""",
    "sec": f"""
SELECT video_id, scene_no, CAST(start_frame AS DOUBLE) / {FPS.format(v='video_id')} AS start_s, CAST(end_frame AS DOUBLE) / {FPS.format(v='video_id')} AS end_s FROM s""",
    "times": f"""
SELECT video_id, CAST(start_frame + 10 AS DOUBLE) / {FPS.format(v='video_id')} AS t FROM s
UNION SELECT video_id, CAST(start_frame AS DOUBLE) / {FPS.format(v='video_id')} + 0.437::DOUBLE + CAST(scene_no % 7 AS DOUBLE) / 10 FROM s
UNION SELECT video_id, CAST(end_frame + 2 AS DOUBLE) / {FPS.format(v='video_id')} FROM s""",
    "shown": """
SELECT q.video_id, q.t, coalesce(q.scene_no, l.scene_no) AS scene_no FROM (
    SELECT x.video_id, x.t, arg_min(c.scene_no, c.start_s) AS scene_no FROM times x LEFT JOIN sec c ON c.video_id = x.video_id AND x.t >= c.start_s AND x.t <= c.end_s GROUP BY 1, 2) q
JOIN (SELECT video_id, arg_max(scene_no, start_s) AS scene_no FROM sec GROUP BY 1) l ON l.video_id = q.video_id""",
}


def scenes_sec(spark, d):
    return an.scenes_in_seconds(box_scenes(spark, d), box_videos(spark, d))


def times(spark, d):
    s = box_scenes(spark, d).withColumn("fps", F.expr(FPS.format(v="video_id")))
    t = F.array(
        (F.col("start_frame") + 10).cast("double") / F.col("fps"),
        F.col("start_frame").cast("double") / F.col("fps") + F.lit(0.437) + (F.col("scene_no") % 7).cast("double") / 10,
        (F.col("end_frame") + 2).cast("double") / F.col("fps"),
    )
    return s.select("video_id", F.explode(t).alias("t")).distinct()


def scenes_in_seconds(spark, d):
    return scenes_sec(spark, d).withColumnsRenamed({"start": "start_s", "end": "end_s"})


QUERIES["scenes_in_seconds"] = scenes_in_seconds
ORACLE["scenes_in_seconds"] = with_views("SELECT * FROM sec", "detections", **VIEW)


def _cuts(spark, d):
    rows = spark.sql(UNION_ROWS.replace("FROM orders", "FROM {orders}"), orders=fx.table(spark, d, "orders"))
    rows = rows.where("type <> 'fade'").withColumn("video_id", F.col("o_orderkey") % 20)
    rows = rows.withColumn("confidence", F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 == 1, F.lit(None)).otherwise(F.col("confidence")))
    rows = rows.withColumnsRenamed({"ts": "timestamp", "start_ts": "start_timestamp", "end_ts": "end_timestamp", "o_orderkey": "transition_id"})
    return an.cuts_in_seconds(rows, box_videos(spark, d))


CUTS = f"""
SELECT o_orderkey AS transition_id, o_orderkey % 20 AS video_id, type, CASE WHEN type = 'hard_cut' THEN coalesce(ts, CAST(coalesce(frame, 0) AS DOUBLE) / f)
        ELSE coalesce(start_ts, CAST(coalesce(start_frame, 0) AS DOUBLE) / f) END AS start_s,
    CASE WHEN type = 'hard_cut' THEN coalesce(ts, CAST(coalesce(frame, 0) AS DOUBLE) / f) ELSE coalesce(end_ts, CAST(coalesce(end_frame, start_frame, 0) AS DOUBLE) / f) END AS end_s,
    CASE WHEN o_orderkey % 7 < 2 THEN 0 ELSE confidence END AS confidence FROM (SELECT *, {FPS.format(v='(o_orderkey % 20)')} AS f FROM ({UNION_ROWS}) u WHERE type <> 'fade') q"""


def cuts_in_seconds(spark, d):
    return _cuts(spark, d).withColumnsRenamed({"start": "start_s", "end": "end_s"})


QUERIES["cuts_in_seconds"] = cuts_in_seconds
ORACLE["cuts_in_seconds"] = CUTS


def track_keyframes(spark, d):
    return an.track_keyframes(tracks(spark, d), box_videos(spark, d))


QUERIES["track_keyframes"] = track_keyframes
ORACLE["track_keyframes"] = with_views("SELECT * FROM kf", "detections", **VIEW)


def track_summary(spark, d):
    return an.track_summary(track_keyframes(spark, d)).select(
        "video_id", "scene_no", "track_id", "class_name", "confidence", "keyframes", F.col("first.t").alias("first_t"), F.col("last.t").alias("last_t")
    )


QUERIES["track_summary"] = track_summary
ORACLE["track_summary"] = with_views(
    """SELECT video_id, scene_no, track_id, arg_min(class_name, k) AS class_name, arg_min(confidence, k) AS confidence, count(*) AS keyframes, min(t) AS first_t, max(t) AS last_t FROM kf GROUP BY 1, 2, 3""",
    "detections", **VIEW,
)


def video_duration(spark, d):
    return an.video_duration(box_videos(spark, d), scenes_sec(spark, d), track_keyframes(spark, d))


QUERIES["video_duration"] = video_duration
ORACLE["video_duration"] = with_views(
    """SELECT video_id, CASE WHEN video_id % 4 = 0 THEN 31.5::DOUBLE WHEN video_id % 8 = 2 THEN 17.25::DOUBLE
    ELSE greatest((SELECT max(end_s) FROM sec WHERE sec.video_id = v.video_id), (SELECT max(t) FROM kf WHERE kf.video_id = v.video_id)) END AS duration
    FROM (SELECT DISTINCT video_id FROM detections) v""",
    "detections", **VIEW,
)


def scene_at(spark, d):
    return an.scene_at(scenes_sec(spark, d), times(spark, d))


QUERIES["scene_at"] = scene_at
ORACLE["scene_at"] = with_views("SELECT * FROM shown", "detections", **VIEW)


def scene_at_hold(spark, d):
    return an.scene_at(scenes_sec(spark, d), times(spark, d), "hold")


QUERIES["scene_at_hold"] = scene_at_hold
ORACLE["scene_at_hold"] = with_views(
    "SELECT x.video_id, x.t, arg_max(c.scene_no, c.start_s) AS scene_no FROM times x LEFT JOIN sec c ON c.video_id = x.video_id AND x.t >= c.start_s GROUP BY 1, 2",
    "detections", **VIEW,
)


def detections_at(spark, d):
    kf = durable(track_keyframes(spark, d))
    return an.detections_at(kf, scenes_sec(spark, d), times(spark, d))


QUERIES["detections_at"] = detections_at
ORACLE["detections_at"] = with_views(
    """SELECT video_id, t, scene_no, track_id, class_name, ax + (bx - ax) * f AS x, ay + (by_ - ay) * f AS y, aw + (bw - aw) * f AS w, ah + (bh - ah) * f AS h, ac + (bc - ac) * f AS confidence FROM (
    SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (t - a_t) / CASE WHEN b_t = a_t THEN 1 ELSE b_t - a_t END)) AS f FROM (
    SELECT p.video_id, p.t, p.scene_no, z.track_id, z.class_name, a.t AS a_t, b.t AS b_t, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS by_, a.w AS aw, b.w AS bw, a.h AS ah, b.h AS bh,
        a.confidence AS ac, b.confidence AS bc
    FROM shown p JOIN (SELECT video_id, scene_no, track_id, arg_min(class_name, k) AS class_name, max(k) AS n FROM kf GROUP BY 1, 2, 3) z ON z.video_id = p.video_id AND z.scene_no = p.scene_no
    LEFT JOIN (SELECT p.video_id, p.t, p.scene_no, m.track_id, min(m.k) AS k FROM shown p JOIN kf m ON m.video_id = p.video_id AND m.scene_no = p.scene_no AND m.t <= p.t
        JOIN kf m2 ON m2.video_id = m.video_id AND m2.scene_no = m.scene_no AND m2.track_id = m.track_id AND m2.k = m.k + 1 AND m2.t >= p.t GROUP BY 1, 2, 3, 4) i
        ON i.video_id = p.video_id AND i.t = p.t AND i.scene_no = p.scene_no AND i.track_id = z.track_id
    JOIN kf a0 ON a0.video_id = p.video_id AND a0.scene_no = p.scene_no AND a0.track_id = z.track_id AND a0.k = 0
    JOIN kf a ON a.video_id = p.video_id AND a.scene_no = p.scene_no AND a.track_id = z.track_id AND a.k = coalesce(i.k, CASE WHEN p.t > a0.t THEN z.n ELSE 0 END)
    JOIN kf b ON b.video_id = p.video_id AND b.scene_no = p.scene_no AND b.track_id = z.track_id AND b.k = coalesce(i.k + 1, CASE WHEN p.t > a0.t THEN z.n ELSE 0 END)) q) r""",
    "detections", **VIEW,
)


def class_counts(spark, d):
    return an.class_counts(tracks(spark, d))


QUERIES["class_counts"] = class_counts
ORACLE["class_counts"] = with_views(
    "SELECT video_id, class_name, count(*) AS tracks FROM (SELECT video_id, scene_no, track_id, arg_min(class_name, frame) AS class_name FROM tracks GROUP BY 1, 2, 3) q GROUP BY 1, 2",
    "detections", **VIEW,
)


def visible_only(spark, d):
    # Written once, with what is asked for, because four branches read it.
    t = durable(tracks(spark, d).select("video_id", "frame", "track_id", "class_name"))
    listed = an.visible_only(t, ["Class-0", "Class-2"])
    chosen = t.select("class_name").distinct().where("class_name > 'Class-1'")
    return listed.select("video_id", "frame", "track_id", F.lit("list").alias("via")).unionByName(
        an.visible_only(t, chosen).select("video_id", "frame", "track_id", F.lit("table").alias("via"))
    ).unionByName(an.visible_only(t, None).select("video_id", "frame", "track_id", F.lit("all").alias("via")))


QUERIES["visible_only"] = visible_only
ORACLE["visible_only"] = with_views(
    """SELECT video_id, frame, track_id, 'list' AS via FROM tracks WHERE class_name IN ('Class-0', 'Class-2')
    UNION ALL SELECT video_id, frame, track_id, 'table' FROM tracks WHERE class_name > 'Class-1' UNION ALL SELECT video_id, frame, track_id, 'all' FROM tracks""",
    "detections", **VIEW,
)


def split_cuts_by_type(spark, d):
    points, bands = an.split_cuts_by_type(_cuts(spark, d))
    return points.select("video_id", F.lit("point").alias("shape"), F.col("t").alias("start_s"), F.col("t").alias("end_s"), "confidence").unionByName(
        bands.select("video_id", F.lit("band").alias("shape"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), "confidence")
    )


QUERIES["split_cuts_by_type"] = split_cuts_by_type
ORACLE["split_cuts_by_type"] = f"""
SELECT video_id, CASE WHEN type = 'hard_cut' THEN 'point' ELSE 'band' END AS shape, start_s, end_s, confidence FROM ({CUTS}) c"""
