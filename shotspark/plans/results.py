"""Scores and boxes of whole videos to result documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shotspark.operators.detect import DetectParams
from shotspark.operators.fusion import class_nms
from shotspark.operators.ownership import build_scenes
from shotspark.operators.results import PART_FRAMES, assemble_results
from shotspark.operators.tracking import TrackParams, assign_scene, associate_tracks, keep_valid
from shotspark.plans.shots import detected
from shotspark.plans.tracks import coupled, number_tracks
from shotspark.session import durable


def results_of_videos(
    videos: DataFrame, chunks: DataFrame, scores: DataFrame, dets: DataFrame, timing: DataFrame, warnings: DataFrame, *,
    detect: DetectParams = DetectParams(), track: TrackParams = TrackParams(), emit: float = 0.5, iou: float = 0.55,
    part_frames: int | None = PART_FRAMES, associate: Callable[[DataFrame, TrackParams], DataFrame] = associate_tracks,
) -> DataFrame:
    """Result documents from what the models report.

    ``scores`` become transitions and scenes; ``dets``, which carry the ``chunk_index`` that
    reported them, count within their chunk's valid range, are fused, placed in scenes,
    associated, emitted and numbered, in this order.  One ``emit`` threshold rules them all.
    ``associate`` may be another tracker.
    """
    transitions = detected(scores, detect)
    scenes = durable(build_scenes(transitions, videos))
    placed = durable(assign_scene(class_nms(keep_valid(dets, chunks), iou), scenes))
    tracks = number_tracks(associate(placed, coupled(track, emit)), videos, emit)
    return assemble_results(videos, scenes, transitions, tracks, timing, warnings, part_frames=part_frames)
