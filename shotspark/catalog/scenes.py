"""F: ownership across chunks and scenes.

Chunk-local detections come from running the detector inside every chunk's context.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.chunking import PLAN_SQL, small_plan, small_videos
from shotspark.catalog.detection import BOUNDARY_RUNS, CONFIRMED, DETECT, GRADUAL_RUNS, HARD, KEPT_HARD, TRANSITIONS
from shotspark.fixtures import with_views
from shotspark.operators import chunks, detect
from shotspark.operators import ownership as own
from shotspark.plans.shots import detected, scenes_of_videos
from shotspark.session import durable

QUERIES: dict = {}
ORACLE: dict = {}

CHUNK_PARAMS = detect.DetectParams(gradual_min_frames=3)

#: One "video" per chunk: the chunk's frames in local coordinates.
_AS_VIDEO = {
    "chunk_scores": """
SELECT f.video_id, p.chunk_index, f.frame - p.context_start AS frame, f.boundary_p, f.transition_p FROM frame_scores f
    JOIN plan p ON f.video_id = p.video_id AND f.frame BETWEEN p.context_start AND p.context_end""",
}


def _per_chunk(sql: str) -> str:
    """The detection CTEs with the chunk as part of the key."""
    sql = sql.replace("frame_scores", "chunk_scores")
    for a in ("g", "r", "s", "h", "c", "x"):
        sql = sql.replace(f"{a}.video_id, ", f"{a}.video_id, {a}.chunk_index, ")
    sql = sql.replace("x.video_id = g.video_id", "x.video_id = g.video_id AND x.chunk_index = g.chunk_index")
    sql = sql.replace("s.video_id = r.video_id", "s.video_id = r.video_id AND s.chunk_index = r.chunk_index")
    sql = sql.replace("c.video_id = h.video_id", "c.video_id = h.video_id AND c.chunk_index = h.chunk_index")
    sql = sql.replace("PARTITION BY video_id", "PARTITION BY video_id, chunk_index")
    sql = sql.replace("SELECT video_id, ", "SELECT video_id, chunk_index, ").replace("GROUP BY video_id, ", "GROUP BY video_id, chunk_index, ")
    return sql.replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4").replace("+ 1 >= 6", "+ 1 >= 3")


CHUNK_DETECT = {
    "plan": PLAN_SQL,
    **_AS_VIDEO,
    **{
        name: _per_chunk(sql)
        for name, sql in (
            ("gradual_runs", GRADUAL_RUNS), ("confirmed", CONFIRMED), ("boundary_runs", BOUNDARY_RUNS),
            ("hard", HARD), ("kept_hard", KEPT_HARD), ("transitions", TRANSITIONS),
        )
    },
    "global_dets": """
SELECT t.video_id, t.chunk_index, type, context_start + start_frame AS start_frame, context_start + end_frame AS end_frame,
    confidence, context_start, context_end, valid_start, valid_end, is_last
FROM transitions t JOIN plan p ON p.video_id = t.video_id AND p.chunk_index = t.chunk_index""",
}


def chunk_detections(spark, d):
    scores = chunks.assign_frames_to_chunks(fx.frame_scores(spark, d), small_videos(spark, d))
    scores = scores.withColumn("frame", F.col("local_frame"))
    found = detect.detect_transitions(scores, CHUNK_PARAMS, keys=["video_id", "chunk_index"])
    return found.withColumnsRenamed({"start_frame": "local_start", "end_frame": "local_end"})


def global_detections(spark, d):
    """What the chunks report; ownership reads it several times, so it is written once."""
    return durable(own.globalise(chunk_detections(spark, d), small_plan(spark, d)))


def globalise(spark, d):
    return global_detections(spark, d).select(
        "video_id", "chunk_index", "type", "start_frame", "end_frame", "confidence", "in_range"
    )


QUERIES["globalise"] = globalise
ORACLE["globalise"] = with_views(
    "SELECT video_id, chunk_index, type, start_frame, end_frame, confidence, true AS in_range FROM global_dets",
    "frame_scores", "videos", **CHUNK_DETECT,
)


def own_hard(spark, d):
    return own.own_hard(global_detections(spark, d)).select("video_id", "chunk_index", F.col("end_frame").alias("frame"), "confidence")


QUERIES["own_hard"] = own_hard
ORACLE["own_hard"] = with_views(
    "SELECT video_id, chunk_index, end_frame AS frame, confidence FROM global_dets WHERE type = 'hard_cut' AND end_frame BETWEEN valid_start AND valid_end",
    "frame_scores", "videos", **CHUNK_DETECT,
)

#: The deferral rules as a walk over the chunks of each video, one step per chunk.
FOLD = {
    "summary": """
SELECT p.video_id, p.chunk_index, p.valid_start, p.context_end, p.is_last,
    min(CASE WHEN g.start_frame <= p.valid_start - 1 AND g.end_frame >= p.valid_start - 1 THEN g.start_frame * 1000000 + g.end_frame END) AS cand,
    min(CASE WHEN g.end_frame = p.context_end AND NOT p.is_last THEN g.start_frame END) AS open_start,
    max(CASE WHEN g.end_frame = p.context_end AND NOT p.is_last THEN g.confidence END) AS open_conf
FROM plan p LEFT JOIN global_dets g ON g.video_id = p.video_id AND g.chunk_index = p.chunk_index AND g.type = 'gradual_transition'
GROUP BY 1, 2, 3, 4, 5""",
    "steps": """
SELECT s.*, cand // 1000000 AS cand_start, cand % 1000000 AS cand_end, g.confidence AS cand_conf FROM summary s
LEFT JOIN global_dets g ON g.video_id = s.video_id AND g.chunk_index = s.chunk_index AND g.type = 'gradual_transition'
    AND g.start_frame = cand // 1000000 AND g.end_frame = cand % 1000000""",
    "fold": """
WITH RECURSIVE walk AS (
    SELECT video_id, chunk_index, CAST(NULL AS BIGINT) AS before_start, CAST(NULL AS DOUBLE) AS before_conf, open_start AS after_start, open_conf AS after_conf
    FROM steps WHERE chunk_index = 0
    UNION ALL
    SELECT s.video_id, s.chunk_index, w.after_start, w.after_conf,
        CASE WHEN s.open_start IS NULL THEN NULL WHEN w.after_start IS NOT NULL AND s.cand_end = s.context_end AND NOT s.is_last THEN least(s.open_start, w.after_start) ELSE s.open_start END,
        CASE WHEN s.open_start IS NULL THEN NULL WHEN w.after_start IS NOT NULL AND s.cand_end = s.context_end AND NOT s.is_last THEN greatest(s.open_conf, w.after_conf) ELSE s.open_conf END
    FROM walk w JOIN steps s ON s.video_id = w.video_id AND s.chunk_index = w.chunk_index + 1)
SELECT * FROM walk""",
    "own_gradual": """
SELECT s.video_id, s.chunk_index, CASE WHEN cand IS NULL THEN before_start ELSE least(before_start, cand_start) END AS start_frame,
    CASE WHEN cand IS NULL THEN valid_start - 1 ELSE cand_end END AS end_frame,
    CASE WHEN cand IS NULL THEN before_conf ELSE greatest(before_conf, cand_conf) END AS confidence
FROM steps s JOIN fold f ON f.video_id = s.video_id AND f.chunk_index = s.chunk_index
WHERE before_start IS NOT NULL AND (cand IS NULL OR cand_end <> context_end OR is_last)
UNION ALL
SELECT g.video_id, g.chunk_index, g.start_frame, g.end_frame, g.confidence FROM global_dets g
JOIN steps s ON s.video_id = g.video_id AND s.chunk_index = g.chunk_index
JOIN fold f ON f.video_id = g.video_id AND f.chunk_index = g.chunk_index
WHERE g.type = 'gradual_transition' AND g.end_frame BETWEEN g.valid_start AND g.valid_end AND (g.end_frame <> g.context_end OR g.is_last)
    AND NOT (before_start IS NOT NULL AND cand IS NOT NULL AND g.start_frame = cand_start AND g.end_frame = cand_end)""",
    "own_kept": """
SELECT video_id, chunk_index, end_frame AS frame, confidence FROM global_dets h WHERE type = 'hard_cut' AND end_frame BETWEEN valid_start AND valid_end
    AND NOT EXISTS (SELECT 1 FROM own_gradual g WHERE g.video_id = h.video_id AND g.chunk_index = h.chunk_index AND h.end_frame BETWEEN g.start_frame AND g.end_frame)""",
    "owned": """
SELECT video_id, chunk_index, 'gradual_transition' AS type, start_frame, end_frame, confidence FROM own_gradual
UNION ALL SELECT video_id, chunk_index, 'hard_cut', frame, frame, confidence FROM own_kept""",
}
OWNED = {**CHUNK_DETECT, **FOLD}


def own_gradual(spark, d):
    return own.own_gradual(global_detections(spark, d), small_plan(spark, d))


QUERIES["own_gradual"] = own_gradual
ORACLE["own_gradual"] = with_views("SELECT * FROM own_gradual", "frame_scores", "videos", **OWNED)


def dedup_owned(spark, d):
    # Before ownership is settled, overlapping contexts report the same transition twice.
    return own.dedup_owned(global_detections(spark, d))


QUERIES["dedup_owned"] = dedup_owned
ORACLE["dedup_owned"] = with_views(
    """SELECT video_id, type, start_frame, end_frame, chunk_index, confidence FROM (SELECT *, row_number() OVER (
    PARTITION BY video_id, type, start_frame, end_frame ORDER BY confidence DESC, chunk_index) AS rn FROM global_dets) q WHERE rn = 1""",
    "frame_scores", "videos", **CHUNK_DETECT,
)


def suppress_owned(spark, d):
    found = global_detections(spark, d)
    gradual = durable(own.own_gradual(found, small_plan(spark, d)))
    return own.suppress_owned(own.own_hard(found), gradual).select(
        "video_id", "chunk_index", F.col("end_frame").alias("frame"), "confidence"
    )


QUERIES["suppress_owned"] = suppress_owned
ORACLE["suppress_owned"] = with_views("SELECT * FROM own_kept", "frame_scores", "videos", **OWNED)


def owned_transitions(found, plan):
    gradual = durable(own.own_gradual(found, plan))
    hard = own.suppress_owned(own.own_hard(found), gradual)
    cols = ["video_id", "chunk_index", "type", "start_frame", "end_frame", "confidence"]
    return gradual.withColumn("type", F.lit("gradual_transition")).select(*cols).unionByName(hard.select(*cols))


SCENES = """
SELECT video_id, scene_no, start_frame, end_frame FROM (
    SELECT video_id, row_number() OVER w - 1 AS scene_no, coalesce(lag(end_frame) OVER w + 1, 0) AS start_frame, end_frame FROM transitions
    WINDOW w AS (PARTITION BY video_id ORDER BY end_frame, start_frame, type)
    UNION ALL
    SELECT v.video_id, count(t.end_frame), coalesce(max(t.end_frame) + 1, 0), v.frame_count - 1 FROM videos v LEFT JOIN transitions t ON t.video_id = v.video_id
    GROUP BY v.video_id, v.frame_count) q
WHERE start_frame <= end_frame"""


def transitions(spark, d):
    return detected(fx.frame_scores(spark, d))


def scenes(spark, d):
    return scenes_of_videos(fx.frame_scores(spark, d), fx.videos(spark, d))


QUERIES["build_scenes"] = scenes
ORACLE["build_scenes"] = with_views("SELECT * FROM scenes", "frame_scores", "videos", **DETECT, scenes=SCENES)


def chunk_scenes(spark, d):
    return own.chunk_scenes(durable(scenes(spark, d)), small_plan(spark, d))


CHUNK_SCENES = """
SELECT s.video_id, p.chunk_index, s.scene_no, greatest(s.start_frame, p.valid_start) AS start_frame, least(s.end_frame, p.valid_end) AS end_frame
FROM scenes s JOIN plan p ON p.video_id = s.video_id AND s.start_frame <= p.valid_end AND p.valid_start <= s.end_frame"""
QUERIES["chunk_scenes"] = chunk_scenes
ORACLE["chunk_scenes"] = with_views(
    "SELECT * FROM cs", "frame_scores", "videos", **DETECT, scenes=SCENES, plan=PLAN_SQL, cs=CHUNK_SCENES
)


def chunk_scene_state(spark, d):
    found, plan = global_detections(spark, d), small_plan(spark, d)
    return own.chunk_scene_state(owned_transitions(found, plan), own.pending_after(found, plan))


QUERIES["chunk_scene_state"] = chunk_scene_state
ORACLE["chunk_scene_state"] = with_views(
    """SELECT f.video_id, f.chunk_index, f.chunk_index + 1 AS next_chunk,
    CAST(sum(coalesce(n, 0)) OVER (PARTITION BY f.video_id ORDER BY f.chunk_index) AS BIGINT) AS active_scene_no,
    after_start AS pending_start, coalesce(after_conf, 0) AS pending_conf
    FROM fold f LEFT JOIN (SELECT video_id, chunk_index, count(*) AS n FROM owned GROUP BY 1, 2) o ON o.video_id = f.video_id AND o.chunk_index = f.chunk_index""",
    "frame_scores", "videos", **OWNED,
)


def require_in_order(spark, d):
    from shotspark.operators.ordered import HOUR_US, micros, scan

    a = fx.chunk_arrivals(spark, d).withColumn("us", micros(F.col("arrived_at")))
    a = scan(a, ["task_id"], F.col("us"), ["event_id"], width=24 * HOUR_US, rank="position")
    flagged = own.require_in_order(a.withColumnRenamed("task_id", "video_id"))
    return flagged.select("video_id", "position", "chunk_index", "expected", "in_order")


QUERIES["require_in_order"] = require_in_order
ORACLE["require_in_order"] = with_views(
    """SELECT *, chunk_index = expected AS in_order FROM (
    SELECT task_id AS video_id, row_number() OVER w - 1 AS position, chunk_index, coalesce(lag(chunk_index) OVER w + 1, 0) AS expected
    FROM chunk_arrivals WINDOW w AS (PARTITION BY task_id ORDER BY arrived_at, event_id)) q""",
    "chunk_arrivals",
)


def cached_or_compute(spark, d):
    plan = small_plan(spark, d).select("video_id", "chunk_index", "valid_start", "valid_end")
    cache = plan.where("(video_id + chunk_index) % 4 = 0").select(
        "video_id", "chunk_index", F.lit(-1).cast("bigint").alias("frames")
    )

    def compute(missing):
        return missing.select("video_id", "chunk_index", (F.col("valid_end") - F.col("valid_start") + 1).alias("frames"))

    return own.cached_or_compute(plan, cache, compute)


QUERIES["cached_or_compute"] = cached_or_compute
ORACLE["cached_or_compute"] = with_views(
    "SELECT video_id, chunk_index, CASE WHEN (video_id + chunk_index) % 4 = 0 THEN -1 ELSE valid_end - valid_start + 1 END AS frames FROM plan",
    "videos", plan=PLAN_SQL,
)
