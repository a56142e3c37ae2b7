"""E: transition detection over ``frame_scores`` and the feature operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.chunking import WINDOWS_SQL
from shotspark.fixtures import with_views
from shotspark.operators import detect

QUERIES: dict = {}
ORACLE: dict = {}

#: Runs of frames above a threshold; the score column and threshold are filled in.
RUNS = """
SELECT video_id, min(frame) AS start_frame, max(frame) AS end_frame FROM (
    SELECT *, frame - row_number() OVER (PARTITION BY video_id ORDER BY frame) AS g FROM frame_scores WHERE {col} > {thr}) q
GROUP BY video_id, g"""

GRADUAL_RUNS = RUNS.format(col="transition_p", thr="0.75")
CONFIRMED = """
SELECT video_id, start_frame, end_frame, sqrt(bp * tp) AS confidence FROM (
    SELECT r.video_id, r.start_frame, r.end_frame, max(s.boundary_p) AS bp, max(s.transition_p) AS tp,
        min(CASE WHEN s.boundary_p = r.peak THEN s.frame END) - r.start_frame AS off,
        CAST(r.end_frame - r.start_frame AS DOUBLE) AS len
    FROM (SELECT g.video_id, g.start_frame, g.end_frame, max(x.boundary_p) AS peak FROM gradual_runs g JOIN frame_scores x
        ON x.video_id = g.video_id AND x.frame BETWEEN g.start_frame AND g.end_frame
        WHERE g.end_frame - g.start_frame + 1 >= 6 GROUP BY 1, 2, 3) r
    JOIN frame_scores s ON s.video_id = r.video_id AND s.frame BETWEEN r.start_frame AND r.end_frame
    GROUP BY r.video_id, r.start_frame, r.end_frame) q
WHERE bp >= 0.65 AND abs(off - len / 2) <= greatest(CAST(1 AS DOUBLE), len * CAST(0.4 AS DOUBLE))"""
BOUNDARY_RUNS = RUNS.format(col="boundary_p", thr="0.55")
HARD = """
SELECT video_id, frame, boundary_p AS confidence FROM (
    SELECT s.*, row_number() OVER (PARTITION BY r.video_id, r.start_frame ORDER BY s.boundary_p DESC, s.frame) AS rn
    FROM boundary_runs r JOIN frame_scores s ON s.video_id = r.video_id AND s.frame BETWEEN r.start_frame AND r.end_frame) q
WHERE rn = 1"""
KEPT_HARD = """
SELECT * FROM hard h WHERE NOT EXISTS (SELECT 1 FROM confirmed c WHERE c.video_id = h.video_id AND h.frame BETWEEN c.start_frame AND c.end_frame)"""
TRANSITIONS = """
SELECT video_id, 'gradual_transition' AS type, start_frame, end_frame, confidence FROM confirmed
UNION ALL SELECT video_id, 'hard_cut', frame, frame, confidence FROM kept_hard"""
#: CTEs that lead to ``transitions``, in order.
DETECT = {
    "gradual_runs": GRADUAL_RUNS, "confirmed": CONFIRMED, "boundary_runs": BOUNDARY_RUNS,
    "hard": HARD, "kept_hard": KEPT_HARD, "transitions": TRANSITIONS,
}


def _runs(df):
    return df.select("video_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), *[c for c in df.columns if c == "confidence"])


def positive_runs(spark, d):
    return _runs(detect.positive_runs(fx.frame_scores(spark, d), "boundary_p", 0.55))


QUERIES["positive_runs"] = positive_runs
ORACLE["positive_runs"] = with_views("SELECT * FROM r", "frame_scores", r=BOUNDARY_RUNS)


def merge_runs(spark, d):
    return _runs(detect.merge_runs(detect.positive_runs(fx.frame_scores(spark, d), "boundary_p", 0.55), 2))


QUERIES["merge_runs"] = merge_runs
ORACLE["merge_runs"] = with_views(
    """SELECT video_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_frame) AS g FROM (
    SELECT *, CASE WHEN start_frame - lag(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame) - 1 <= 2 THEN 0 ELSE 1 END AS fresh
    FROM r) a) b GROUP BY video_id, g""",
    "frame_scores", r=BOUNDARY_RUNS,
)


def min_length(spark, d):
    return _runs(detect.min_length(detect.positive_runs(fx.frame_scores(spark, d), "transition_p", 0.75), 6))


QUERIES["min_length"] = min_length
ORACLE["min_length"] = with_views("SELECT * FROM r WHERE end_frame - start_frame + 1 >= 6", "frame_scores", r=GRADUAL_RUNS)


def confirm_gradual(spark, d):
    scores = fx.frame_scores(spark, d)
    return _runs(detect.confirm_gradual(detect.min_length(detect.positive_runs(scores, "transition_p", 0.75), 6), scores))


QUERIES["confirm_gradual"] = confirm_gradual
ORACLE["confirm_gradual"] = with_views("SELECT * FROM confirmed", "frame_scores", gradual_runs=GRADUAL_RUNS, confirmed=CONFIRMED)


def hard_cut_peaks(spark, d):
    return detect.hard_cut_peaks(fx.frame_scores(spark, d))


QUERIES["hard_cut_peaks"] = hard_cut_peaks
ORACLE["hard_cut_peaks"] = with_views("SELECT * FROM hard", "frame_scores", boundary_runs=BOUNDARY_RUNS, hard=HARD)


def suppress_inside(spark, d):
    scores = fx.frame_scores(spark, d)
    gradual = detect.confirm_gradual(detect.min_length(detect.positive_runs(scores, "transition_p", 0.75), 6), scores)
    return detect.suppress_inside(detect.hard_cut_peaks(scores), gradual)


QUERIES["suppress_inside"] = suppress_inside
ORACLE["suppress_inside"] = with_views("SELECT * FROM kept_hard", "frame_scores", **DETECT)


def detect_transitions(spark, d):
    return detect.detect_transitions(fx.frame_scores(spark, d))


QUERIES["detect_transitions"] = detect_transitions
ORACLE["detect_transitions"] = with_views("SELECT * FROM transitions", "frame_scores", **DETECT)


def _shots(spark, d):
    """Shots with a varying gap over all frames of ``frame_scores``, of which they gather 16 each."""
    cut = F.expr("frame div 16")
    return (
        fx.frame_scores(spark, d)
        .groupBy("video_id", cut.alias("shot_no"))
        .agg(F.min("frame").alias("start"))
        .withColumn("end", F.col("start") + 15 - (F.col("start") + F.col("video_id")) % 5)
    )


SHOTS = """
SELECT video_id, shot_no, s, s + 15 - (s + video_id) % 5 AS e FROM (SELECT video_id, frame // 16 AS shot_no, min(frame) AS s FROM frame_scores GROUP BY 1, 2) f"""
PAIRS = """
SELECT video_id, CASE WHEN s - p <= 2 THEN 'hard_cut' ELSE 'gradual_transition' END AS type,
    CASE WHEN s - p <= 2 THEN s ELSE p END AS start_frame, s AS end_frame, p AS gap_start FROM (
    SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY shot_no) AS p FROM shots) q WHERE p IS NOT NULL"""


def transitions_from_ranges(spark, d):
    return detect.transitions_from_ranges(_shots(spark, d)).drop("gap_start")


QUERIES["transitions_from_ranges"] = transitions_from_ranges
ORACLE["transitions_from_ranges"] = with_views(
    "SELECT video_id, type, start_frame, end_frame, CAST(NULL AS DOUBLE) AS confidence FROM pairs",
    "frame_scores", shots=SHOTS, pairs=PAIRS,
)


def transitions_from_scene_scores(spark, d):
    """Some gaps have no score at all."""
    known = F.when(F.expr("frame div 64 % 3 <> 1"), F.col("boundary_p"))
    scores = fx.frame_scores(spark, d).select("video_id", "frame", known.alias("score"))
    return detect.transitions_from_scene_scores(_shots(spark, d), scores, digits=None)


QUERIES["transitions_from_scene_scores"] = transitions_from_scene_scores
ORACLE["transitions_from_scene_scores"] = with_views(
    """SELECT p.video_id, p.type, p.start_frame, p.end_frame, max(CASE WHEN s.frame // 64 % 3 <> 1 THEN s.boundary_p END) AS confidence FROM pairs p LEFT JOIN frame_scores s
    ON s.video_id = p.video_id AND s.frame BETWEEN p.gap_start AND p.end_frame GROUP BY 1, 2, 3, 4""",
    "frame_scores", shots=SHOTS, pairs=PAIRS,
)


def toy_scorer():
    """Stand-in for a user model over windows of 32 frames: jump against the window's previous frame."""

    def model(windows: pd.DataFrame) -> pd.DataFrame:
        v = windows["brightness"].to_numpy("float64").reshape(-1, 32)
        jump = np.abs(np.diff(v, axis=1, prepend=v[:, :1])) / 255.0
        return pd.DataFrame({"boundary_p": jump.ravel(), "transition_p": v.ravel() / 255.0})

    return model


def _frames(spark, d):
    scores = fx.frame_scores(spark, d)
    return scores.select("video_id", "frame", F.floor(F.col("boundary_p") * 255).cast("bigint").alias("brightness"))


FRAMES = "SELECT video_id, frame, CAST(floor(boundary_p * 255) AS BIGINT) AS brightness FROM frame_scores"
WINDOW_SCORES = """
SELECT w.video_id, w.window_no, f.frame, CAST(f.brightness AS DOUBLE) / 255 AS transition_p,
    CASE WHEN f.frame = w.start_frame THEN CAST(0 AS DOUBLE) ELSE CAST(abs(f.brightness - p.brightness) AS DOUBLE) / 255 END AS boundary_p
FROM windows w JOIN frames f ON f.video_id = w.video_id AND f.frame BETWEEN w.start_frame AND w.end_frame
LEFT JOIN frames p ON p.video_id = f.video_id AND p.frame = f.frame - 1"""
SCORED = {"windows": WINDOWS_SQL, "frames": FRAMES, "window_scores": WINDOW_SCORES}


def score_frames(spark, d):
    return detect.score_frames(_frames(spark, d), toy_scorer, fx.videos(spark, d), window=32, overlap=8)


QUERIES["score_frames"] = score_frames
ORACLE["score_frames"] = with_views("SELECT * FROM window_scores", "videos", "frame_scores", **SCORED)


def average_window_scores(spark, d):
    return detect.average_window_scores(score_frames(spark, d))


QUERIES["average_window_scores"] = average_window_scores
ORACLE["average_window_scores"] = with_views(
    "SELECT video_id, frame, sum(boundary_p) / count(*) AS boundary_p, sum(transition_p) / count(*) AS transition_p FROM window_scores GROUP BY 1, 2",
    "videos", "frame_scores", **SCORED,
)


def banded_similarity(spark, d):
    band = detect.banded_similarity(fx.frame_features(spark, d), 101)
    return band.select("video_id", "frame", F.posexplode("similarity").alias("slot", "s")).select(
        "video_id", "frame", F.col("slot").cast("bigint").alias("slot"), F.round("s", 6).alias("similarity")
    )


QUERIES["banded_similarity"] = banded_similarity
ORACLE["banded_similarity"] = with_views(
    """SELECT a.video_id, a.frame, a.slot, coalesce(round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6), 0) AS similarity
    FROM (SELECT *, unnest(range(0, 101)) AS slot FROM f) a LEFT JOIN f b ON b.video_id = a.video_id AND b.frame = a.frame + a.slot - 50""",
    "frame_features",
    f="SELECT CAST(video_id AS BIGINT) AS video_id, frame, CAST(embedding AS DOUBLE[]) AS e FROM frame_features",
)


def rgb_histogram(spark, d):
    return detect.rgb_histogram(fx.pixels(spark, d))


QUERIES["rgb_histogram"] = rgb_histogram
ORACLE["rgb_histogram"] = with_views(
    """SELECT video_id, frame, bin, CAST(n AS DOUBLE) / sqrt(CAST(sum(n * n) OVER (PARTITION BY video_id, frame) AS DOUBLE)) AS weight FROM (
    SELECT video_id, frame, CAST((r // 32) * 64 + (g // 32) * 8 + b // 32 AS BIGINT) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2, 3) q""",
    "pixels",
)
