"""Whole-pipeline plans: which intermediate tables are written, and which are not."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shotspark.operators.detect import DetectParams, detect_transitions
from shotspark.operators.ownership import build_scenes
from shotspark.session import durable


def detected(scores: DataFrame, params: DetectParams = DetectParams()) -> DataFrame:
    """Transitions as a written table.

    There are orders of magnitude fewer transitions than frames and every later step reads
    them more than once, so the score table is scanned for them exactly once.
    """
    return durable(detect_transitions(scores, params))


def scenes_of_videos(scores: DataFrame, videos: DataFrame, params: DetectParams = DetectParams()) -> DataFrame:
    """Scores to scenes of every video."""
    return build_scenes(detected(scores, params), videos)
