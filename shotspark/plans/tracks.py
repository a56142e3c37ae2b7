"""Boxes of two detectors to numbered tracks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.operators.fusion import class_nms, emit_tracks
from shotspark.operators.tracking import TrackParams, assign_scene, associate_tracks, dense_track_ids
from shotspark.session import durable


def raw_tracks(dets: DataFrame, scenes: DataFrame, params: TrackParams = TrackParams(), iou: float = 0.55) -> DataFrame:
    """Fused boxes placed in scenes and associated.

    Fused boxes are written because segmentation reads them twice; association returns a
    written table already.
    """
    placed = durable(assign_scene(class_nms(dets, iou), scenes))
    return associate_tracks(placed, params)


def coupled(params: TrackParams, emit: float) -> TrackParams:
    """What may be published is what matches first, and nothing below it starts a track."""
    return replace(params, low=min(params.low, emit), high=emit, new=max(params.new, emit))


def number_tracks(raw: DataFrame, videos: DataFrame, emit: float = 0.5) -> DataFrame:
    """Raw tracks as published: confident boxes cut to the frame, numbered by first emission."""
    size = videos.select("video_id", F.col("width").alias("__w"), F.col("height").alias("__h"))
    seen = emit_tracks(raw.join(size, "video_id"), F.col("__w"), F.col("__h"), emit)
    return dense_track_ids(seen.drop("__w", "__h"))


def track_videos(
    dets: DataFrame, scenes: DataFrame, videos: DataFrame, params: TrackParams = TrackParams(), *,
    emit: float = 0.5, iou: float = 0.55,
) -> DataFrame:
    """Boxes to tracks numbered from 0 in every scene; ``videos`` gives ``width, height``."""
    return number_tracks(raw_tracks(dets, scenes, coupled(params, emit), iou), videos, emit)
