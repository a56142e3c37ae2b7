"""G: fusion and tracking over ``detections``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.chunking import small_plan
from shotspark.catalog.scenes import CHUNK_SCENES, OWNED, SCENES, global_detections, owned_transitions
from shotspark.fixtures import with_views
from shotspark.functions.boxes import iou
from shotspark.operators import fusion, tracking
from shotspark.operators import ownership as own
from shotspark.operators.tracking import TrackParams
from shotspark.plans.tracks import number_tracks, raw_tracks, track_videos
from shotspark.session import durable

QUERIES: dict = {}
ORACLE: dict = {}

#: Scenes of the detection videos: 45 frames, then 5 frames that belong to none.
BOX_SCENES = """
SELECT video_id, k AS scene_no, k * 50 AS start_frame, k * 50 + 44 AS end_frame FROM (
    SELECT video_id, unnest(range(0, max(frame) // 50 + 1)) AS k FROM detections GROUP BY video_id) q"""


def box_scenes(spark, d):
    last = fx.detections(spark, d).groupBy("video_id").agg(F.max("frame").alias("f"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("f div 50")))
    return last.select("video_id", k.alias("scene_no")).select(
        "video_id", "scene_no", (F.col("scene_no") * 50).alias("start_frame"), (F.col("scene_no") * 50 + 44).alias("end_frame")
    )


def union_detectors(spark, d):
    dets = fx.detections(spark, d)
    both = fusion.union_detectors(dets.where("detector = 0"), dets.where("detector = 1"))
    return both.select("video_id", "frame", F.col("detector").cast("bigint").alias("detector"), "det_idx", "conf")


QUERIES["union_detectors"] = union_detectors
ORACLE["union_detectors"] = with_views(
    "SELECT video_id, frame, CAST(detector AS BIGINT) AS detector, det_idx, conf FROM detections", "detections"
)

IOU = """CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN
    ((least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))
    / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)
    - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) ELSE 0 END"""


def box_iou(spark, d):
    """Each box against the next one of its frame."""
    dets = fx.detections(spark, d).select("video_id", "frame", "det_idx", F.struct("x1", "y1", "x2", "y2").alias("a"))
    nxt = dets.select("video_id", "frame", (F.col("det_idx") - 1).alias("det_idx"), F.col("a").alias("b"))
    return dets.join(nxt, ["video_id", "frame", "det_idx"]).select(
        "video_id", "frame", "det_idx", iou(F.col("a"), F.col("b")).alias("iou")
    )


QUERIES["iou"] = box_iou
ORACLE["iou"] = with_views(
    f"""SELECT a.video_id, a.frame, a.det_idx, CAST({IOU.format(a='a', b='b')} AS DOUBLE) AS iou FROM detections a
    JOIN detections b ON b.video_id = a.video_id AND b.frame = a.frame AND b.det_idx = a.det_idx + 1""",
    "detections",
)


def class_nms(spark, d):
    return fusion.class_nms(fx.detections(spark, d)).select("video_id", "frame", "det_idx", "class_name", "conf")


QUERIES["class_nms"] = class_nms
#: Greedy suppression rank by rank: the kept ranks of a group grow along the recursion.
NMS = {
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY video_id, frame, class_name ORDER BY conf DESC, detector, det_idx) AS rk FROM detections""",
    "clash": f"""
SELECT b.video_id, b.frame, b.class_name, b.rk, list(a.rk) AS above FROM ranked b JOIN ranked a ON a.video_id = b.video_id AND a.frame = b.frame
    AND a.class_name = b.class_name AND a.rk < b.rk AND {IOU.format(a='a', b='b')} >= 0.55::DOUBLE GROUP BY ALL""",
    "nms": """
WITH RECURSIVE walk AS (
    SELECT video_id, frame, class_name, CAST(1 AS BIGINT) AS rk, [CAST(1 AS BIGINT)] AS kept FROM ranked WHERE rk = 1
    UNION ALL
    SELECT w.video_id, w.frame, w.class_name, r.rk, CASE WHEN list_has_any(coalesce(c.above, []), w.kept) THEN w.kept ELSE list_append(w.kept, r.rk) END
    FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.frame = w.frame AND r.class_name = w.class_name AND r.rk = w.rk + 1
    LEFT JOIN clash c ON c.video_id = r.video_id AND c.frame = r.frame AND c.class_name = r.class_name AND c.rk = r.rk)
SELECT r.* FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.frame = w.frame AND r.class_name = w.class_name AND r.rk = w.rk
WHERE list_contains(w.kept, r.rk)""",
}
ORACLE["class_nms"] = with_views("SELECT video_id, frame, det_idx, class_name, conf FROM nms", "detections", **NMS)


def assign_scene(spark, d):
    return tracking.assign_scene(fx.detections(spark, d), box_scenes(spark, d)).select("video_id", "frame", "det_idx", "scene_no")


QUERIES["assign_scene"] = assign_scene
ORACLE["assign_scene"] = with_views(
    """SELECT t.video_id, t.frame, t.det_idx, s.scene_no FROM detections t JOIN s ON s.video_id = t.video_id AND t.frame BETWEEN s.start_frame AND s.end_frame""",
    "detections", s=BOX_SCENES,
)


def associate_tracks(spark, d):
    return track_videos(fx.detections(spark, d), box_scenes(spark, d), _sizes(spark, d)).select(
        "video_id", "scene_no", "frame", "track_id", "class_name", "confidence", "x", "y", "width", "height"
    )


def _sizes(spark, d):
    videos = fx.detections(spark, d).select("video_id").distinct()
    return videos.withColumns({"width": F.lit(1280), "height": F.lit(720)})


QUERIES["associate_tracks"] = associate_tracks


def track_properties(spark, d):
    """What every association must keep, counted per video: all counts are 0."""
    dets = fx.detections(spark, d)
    raw = durable(raw_tracks(dets, box_scenes(spark, d), TrackParams(), 0.55))
    track = ["video_id", "scene_no", "segment", "raw_id"]
    before = F.lag("frame").over(Window.partitionBy(*track).orderBy("frame"))
    per_box = raw.groupBy("video_id", "frame", "detector", "det_idx").count().where("count > 1")
    per_frame = raw.groupBy(*track, "frame").count().where("count > 1")
    gaps = raw.select("video_id", (F.col("frame") - before).alias("gap")).where(F.col("gap") > TrackParams().buffer)
    numbered = number_tracks(raw, _sizes(spark, d)).groupBy("video_id", "scene_no").agg(
        (F.max("track_id") + 1 - F.count_distinct("track_id")).alias("n")
    )
    named = {"repeated_boxes": per_box, "shared_frames": per_frame, "long_gaps": gaps, "id_holes": numbered.where("n <> 0")}
    found = dets.select("video_id").distinct()
    for name, bad in named.items():
        found = found.join(bad.groupBy("video_id").agg(F.count("*").alias(name)), "video_id", "left")
    return found.select("video_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in named])


QUERIES["track_properties"] = track_properties
ORACLE["track_properties"] = with_views(
    """SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS repeated_boxes, CAST(0 AS BIGINT) AS shared_frames, CAST(0 AS BIGINT) AS long_gaps,
    CAST(0 AS BIGINT) AS id_holes FROM detections""",
    "detections",
)


def _labelled(spark, d):
    """Boxes with a stand-in raw id, so that numbering can be checked by itself."""
    scenes = tracking.assign_scene(fx.detections(spark, d).where("conf >= 0.5"), box_scenes(spark, d))
    return scenes.withColumns(
        {"segment": F.lit(0).cast("bigint"), "raw_id": (F.col("det_idx") * 5 + F.col("frame")) % 23}
    )


def dense_track_ids(spark, d):
    return tracking.dense_track_ids(_labelled(spark, d)).select("video_id", "scene_no", "frame", "det_idx", "raw_id", "track_id")


QUERIES["dense_track_ids"] = dense_track_ids
ORACLE["dense_track_ids"] = with_views(
    """SELECT r.video_id, r.scene_no, r.frame, r.det_idx, r.raw_id, f.track_id FROM r JOIN (
    SELECT video_id, scene_no, raw_id, row_number() OVER (PARTITION BY video_id, scene_no ORDER BY m) - 1 AS track_id FROM (
    SELECT video_id, scene_no, raw_id, min(frame * 10000 + detector * 1000 + det_idx) AS m FROM r GROUP BY 1, 2, 3) a) f
    ON f.video_id = r.video_id AND f.scene_no = r.scene_no AND f.raw_id = r.raw_id""",
    "detections", s=BOX_SCENES,
    r="""
SELECT t.*, s.scene_no, (det_idx * 5 + frame) % 23 AS raw_id FROM detections t JOIN s ON s.video_id = t.video_id AND t.frame BETWEEN s.start_frame AND s.end_frame WHERE conf >= 0.5::DOUBLE""",
)


def tracker_resets(spark, d):
    found, plan = global_detections(spark, d), small_plan(spark, d)
    owned = durable(owned_transitions(found, plan))
    scenes = durable(own.build_scenes(owned, fx.videos(spark, d)))
    out = tracking.tracker_resets(own.chunk_scenes(scenes, plan), owned)
    return out.select("video_id", "chunk_index", "scene_no", "start_frame", "after_cut", "scene_changed")


QUERIES["tracker_resets"] = tracker_resets
ORACLE["tracker_resets"] = with_views(
    """SELECT c.video_id, c.chunk_index, c.scene_no, c.start_frame, EXISTS (SELECT 1 FROM owned o WHERE o.video_id = c.video_id AND o.chunk_index = c.chunk_index
        AND o.end_frame + 1 = c.start_frame) AS after_cut,
    lag(c.scene_no) OVER (PARTITION BY c.video_id ORDER BY c.start_frame) IS DISTINCT FROM c.scene_no AS scene_changed FROM cs c""",
    "frame_scores", "videos", **OWNED,
    scenes=SCENES.replace("FROM transitions", "FROM owned").replace("JOIN transitions", "JOIN owned"), cs=CHUNK_SCENES,
)


def emit_tracks(spark, d):
    raw = _labelled(spark, d).withColumn("class_name", F.when(F.col("class_name") != "Class-3", F.col("class_name")))
    return fusion.emit_tracks(raw, F.lit(75), F.lit(70), 0.6).select(
        "video_id", "frame", "det_idx", "class_name", "confidence", "x", "y", "width", "height"
    )


QUERIES["emit_tracks"] = emit_tracks
ORACLE["emit_tracks"] = with_views(
    """SELECT t.video_id, frame, det_idx, class_name, conf AS confidence, least(x1, 75) AS x, least(y1, 70) AS y,
    least(x2, 75) - least(x1, 75) AS width, least(y2, 70) - least(y1, 70) AS height
    FROM detections t JOIN s ON s.video_id = t.video_id AND t.frame BETWEEN s.start_frame AND s.end_frame
    WHERE conf >= 0.6::DOUBLE AND class_name <> 'Class-3' AND x1 < 75 AND y1 < 70""",
    "detections", s=BOX_SCENES,
)
