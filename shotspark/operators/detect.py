"""Per-frame scores to shot transitions (E)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.operators.blocks import sorted_by, whole_groups
from shotspark.operators.ordered import BLOCK, islands, locate, scan, with_halo
from shotspark.session import durable


@dataclass(frozen=True)
class DetectParams:
    boundary_threshold: float = 0.55
    gradual_threshold: float = 0.75
    gradual_boundary_threshold: float = 0.65
    gradual_min_frames: int = 6
    gradual_merge_gap: int = 0
    block: int = BLOCK


#: Scores of several windows: one DataFrame in, one with as many rows out.
Model = Callable[[pd.DataFrame], pd.DataFrame]

#: Default grouping; pass ("video_id", "chunk_index") to detect inside every chunk.
KEY = ("video_id",)


# ---------------------------------------------------------------- windows and scores


#: Models of this Python worker, by the call that asked for them.
_MODELS: dict[str, Model] = {}


def score_frames(
    frames: DataFrame,
    load: Callable[[], Model],
    frame_counts: DataFrame,
    *,
    window: int = 100,
    overlap: int = 20,
    windows_per_call: int = 8,
    strip: int = 32,
) -> DataFrame:
    """Run a user model over overlapping windows of every video.

    ``load`` returns the model and is called once per Python worker.  The model receives up
    to ``windows_per_call`` windows at a time as one DataFrame, ``window`` rows each in frame order, windows
    shorter than that padded with copies of their last frame; it returns ``boundary_p`` and
    ``transition_p`` per row.  Scores of padded rows are dropped.  One row per (video, window,
    frame) comes back; average them with :func:`average_window_scores`.

    Frames travel once, in strips of ``strip`` consecutive windows: only the frames that two
    strips share are copied, which is ``overlap`` in every ``strip * (window - overlap)``, and
    windows are cut where the strip lies.  A task holds a few windows, never a whole video.
    """
    step = window - overlap
    part = ["video_id", "__strip"]
    schema = T.StructType(
        [f for f in frames.schema if f.name == "video_id"]
        + [
            T.StructField("window_no", T.LongType()),
            T.StructField("frame", T.LongType()),
            T.StructField("boundary_p", T.DoubleType()),
            T.StructField("transition_p", T.DoubleType()),
        ]
    )
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - window) / step) + 1)
    strips = F.sequence(F.floor(first / strip), F.floor(F.col("frame") / (step * strip)))
    placed = frames.where("frame >= 0").withColumn("__strip", F.explode(strips))
    # Each strip is told by one row how long its video is; frames themselves join nothing.
    last = F.floor(last_window(F.col("frame_count"), window, step) / strip)
    told = frame_counts.where("frame_count > 0").select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__strip"), F.col("frame_count").cast("bigint").alias("__count")
    )
    marked = placed.withColumn("__count", F.lit(None).cast("bigint")).unionByName(told, allowMissingColumns=True)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS[name] = load()
        model = _MODELS[name]
        for table, group in whole_groups(batches, part, windows_per_call * window):
            told = np.flatnonzero(table["__count"].is_valid().to_numpy())
            frame = pc.fill_null(table["frame"], -1).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
            wanted: list[tuple[int, np.ndarray]] = []
            for at in told.tolist():
                # The row that tells the length has no frame and comes first in its strip.
                low, high = at + 1, int(ends[group[at]])
                count, number = table["__count"][at].as_py(), table["__strip"][at].as_py()
                high = low + int(np.searchsorted(frame[low:high], count))
                final = max(0, -(-(count - window) // step))
                for w in range(number * strip, min(final, number * strip + strip - 1) + 1):
                    s, e = low + np.searchsorted(frame[low:high], [w * step, w * step + window])
                    if e > s:
                        wanted.append((w, np.arange(s, e)))
            rows = table.drop_columns(["__strip", "__count"])
            for k in range(0, len(wanted), windows_per_call):
                some = wanted[k : k + windows_per_call]
                padded = [np.append(at, np.repeat(at[-1:], window - len(at))) for _, at in some]
                scores = model(rows.take(pa.array(np.concatenate(padded))).to_pandas())
                real = np.concatenate([np.arange(window) < len(at) for _, at in some])
                own = np.concatenate([at for _, at in some])
                yield pa.record_batch(
                    [
                        rows["video_id"].take(pa.array(own)).combine_chunks(),
                        pa.array(np.repeat([w for w, _ in some], [len(at) for _, at in some]), pa.int64()),
                        pa.array(frame[own], pa.int64()),
                        *(pa.array(np.asarray(scores[c], np.float64)[real]) for c in ("boundary_p", "transition_p")),
                    ],
                    names=schema.names,
                )

    return sorted_by(marked, part, ("frame",)).mapInArrow(run, schema)


def last_window(frame_count, window: int, step: int):
    """Index of the last model window: the first one that reaches the end of the video."""
    return F.when(frame_count <= window, F.lit(0).cast("bigint")).otherwise(
        F.ceil((frame_count - window) / F.lit(step)).cast("bigint")
    )


def average_window_scores(scores: DataFrame) -> DataFrame:
    """Mean over all windows that cover a frame."""
    return scores.groupBy("video_id", "frame").agg(
        (F.sum("boundary_p") / F.count(F.lit(1))).alias("boundary_p"),
        (F.sum("transition_p") / F.count(F.lit(1))).alias("transition_p"),
    )


# ---------------------------------------------------------------- runs


def positive_runs(scores: DataFrame, col: str, threshold: float, *, keys=KEY, block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive frames with ``col > threshold``."""
    hot = scores.where(F.col(col) > threshold)
    return islands(hot, keys, F.col("frame"), F.col("frame"), width=block)


def merge_runs(runs: DataFrame, gap: int, *, keys=KEY, block: int = BLOCK) -> DataFrame:
    """Join runs that lie at most ``gap`` frames apart."""
    return islands(runs, keys, F.col("start"), F.col("end"), gap=gap, width=block)


def min_length(runs: DataFrame, frames: int) -> DataFrame:
    """E5."""
    return runs.where(F.col("end") - F.col("start") + 1 >= frames)


def _first_peak(score: str):
    """Ordering value whose maximum is the highest score at its smallest frame."""
    return F.struct(F.col(score).alias("p"), (-F.col("frame")).alias("neg_frame"))


def confirm_gradual(
    runs: DataFrame, scores: DataFrame, params: DetectParams = DetectParams(), *, keys=KEY
) -> DataFrame:
    """Keep runs whose boundary peak is high and near their middle.

    Every score row finds its run by an ordered merge, then the peak is a grouped maximum
    with map-side combine, so neither a long run nor a long video gathers in one task.
    """
    inside = locate(
        scores.select(*keys, "frame", "boundary_p", "transition_p"),
        runs.select(*keys, "start", "end"),
        keys, "frame", "start", "end", width=params.block,
    )
    peaks = inside.groupBy(*keys, "start", "end").agg(
        F.max(_first_peak("boundary_p")).alias("peak"),
        F.max("transition_p").alias("transition_peak"),
    )
    return _confirmed(peaks, params, keys)


def _confirmed(peaks: DataFrame, params: DetectParams, keys) -> DataFrame:
    """Runs with their peaks that pass as gradual transitions."""
    length = (F.col("end") - F.col("start")).cast("double")
    offset = (-F.col("peak.neg_frame") - F.col("start")).cast("double")
    return peaks.where(
        (F.col("peak.p") >= params.gradual_boundary_threshold)
        & (F.abs(offset - length / F.lit(2.0)) <= F.greatest(F.lit(1.0), length * F.lit(0.4)))
    ).select(
        *keys,
        "start",
        "end",
        F.sqrt(F.col("peak.p") * F.col("transition_peak")).alias("confidence"),
    )


def hard_cut_peaks(scores: DataFrame, threshold: float = 0.55, *, keys=KEY, block: int = BLOCK) -> DataFrame:
    """One cut per boundary run, at the first frame that reaches the run's maximum."""
    runs = islands(
        scores.where(F.col("boundary_p") > threshold),
        keys, F.col("frame"), F.col("frame"), width=block,
        maxes={"peak": _first_peak("boundary_p")},
    )
    return runs.select(
        *keys,
        (-F.col("peak.neg_frame")).cast("bigint").alias("frame"),
        F.col("peak.p").alias("confidence"),
    )


def suppress_inside(hard: DataFrame, gradual: DataFrame, *, keys=KEY, block: int = BLOCK) -> DataFrame:
    """Drop hard cuts that lie inside a confirmed gradual transition."""
    return locate(hard, gradual.select(*keys, "start", "end"), keys, "frame", "start", "end", how="anti", width=block)


def detect_transitions(scores: DataFrame, params: DetectParams = DetectParams(), *, keys=KEY) -> DataFrame:
    """``video_id, type, start_frame, end_frame, confidence`` (hard: both frames equal).

    Without a merge gap every frame of a run is above its threshold, so one pass over the
    scores finds the runs of both kinds with their peaks.  With a gap, runs also hold frames
    below it, which a second pass has to look up.
    """
    if not params.gradual_merge_gap:
        return _detect_in_one_pass(scores, params, keys)
    # Merging runs with a gap equals merging the positive frames with the same gap.
    runs = islands(
        scores.where(F.col("transition_p") > params.gradual_threshold),
        keys, F.col("frame"), F.col("frame"), gap=params.gradual_merge_gap, width=params.block,
    )
    gradual = confirm_gradual(min_length(runs, params.gradual_min_frames), scores, params, keys=keys)
    peaks = hard_cut_peaks(scores, params.boundary_threshold, keys=keys, block=params.block)
    return as_transitions(suppress_inside(peaks, gradual, keys=keys, block=params.block), gradual, keys=keys)


def _detect_in_one_pass(scores: DataFrame, params: DetectParams, keys) -> DataFrame:
    gradual, hard = F.col("transition_p") > params.gradual_threshold, F.col("boundary_p") > params.boundary_threshold
    kinds = F.array_compact(F.array(F.when(gradual, F.lit("gradual")), F.when(hard, F.lit("hard"))))
    hot = scores.where(gradual | hard).select(*keys, "frame", "boundary_p", "transition_p", F.explode(kinds).alias("__kind"))
    # There are few runs and three steps read them: written once, the scores are read once.
    runs = durable(
        islands(
            hot, [*keys, "__kind"], F.col("frame"), F.col("frame"), width=params.block,
            maxes={"peak": _first_peak("boundary_p"), "transition_peak": F.col("transition_p")},
        )
    )
    of = lambda kind: runs.where(F.col("__kind") == kind).drop("__kind")
    found = _confirmed(min_length(of("gradual"), params.gradual_min_frames), params, keys)
    peaks = of("hard").select(
        *keys, (-F.col("peak.neg_frame")).cast("bigint").alias("frame"), F.col("peak.p").alias("confidence")
    )
    return as_transitions(suppress_inside(peaks, found, keys=keys, block=params.block), found, keys=keys)


def as_transitions(hard: DataFrame, gradual: DataFrame, *, keys=KEY) -> DataFrame:
    return gradual.select(
        *keys,
        F.lit("gradual_transition").alias("type"),
        F.col("start").alias("start_frame"),
        F.col("end").alias("end_frame"),
        "confidence",
    ).unionByName(
        hard.select(
            *keys,
            F.lit("hard_cut").alias("type"),
            F.col("frame").alias("start_frame"),
            F.col("frame").alias("end_frame"),
            "confidence",
        )
    )


# ---------------------------------------------------------------- other detectors' output


def transitions_from_ranges(ranges: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Neighbouring shots ``(video_id, shot_no, start, end)`` to transitions, no score."""
    followed = scan(
        ranges, KEY, F.col("shot_no"), width=block,
        previous={"prev_end": F.col("end")},
    ).where("prev_end is not null")
    hard = F.col("start") - F.col("prev_end") <= 2
    return followed.select(
        "video_id",
        F.when(hard, F.lit("hard_cut")).otherwise(F.lit("gradual_transition")).alias("type"),
        F.when(hard, F.col("start")).otherwise(F.col("prev_end")).alias("start_frame"),
        F.col("start").alias("end_frame"),
        F.col("prev_end").alias("gap_start"),
        F.lit(None).cast("double").alias("confidence"),
    )


def transitions_from_scene_scores(scenes: DataFrame, scores: DataFrame, *, digits: int | None = 4, block: int = BLOCK) -> DataFrame:
    """As E11, with the highest score in the closed gap as confidence.

    Gaps of neighbouring shots may share an end frame, so each gap is spread over its frames
    and joined on ``(video_id, frame)``; gaps are short compared with shots.  Where shots
    overlap, the score at the end of the first counts; a gap without any score has no
    confidence.
    """
    found = transitions_from_ranges(scenes, block=block).drop("confidence")
    gap = F.sequence("gap_start", F.greatest("gap_start", "end_frame"))
    spread = found.withColumn("frame", F.explode(gap))
    best = spread.join(scores.select("video_id", "frame", "score"), ["video_id", "frame"], "left")
    best = best.groupBy("video_id", "type", "start_frame", "end_frame").agg(F.max("score").alias("confidence"))
    if digits is not None:
        best = best.withColumn("confidence", F.bround("confidence", digits))
    return best


# ---------------------------------------------------------------- weight-free features


def banded_similarity(features: DataFrame, width: int = 101, *, block: int = 512) -> DataFrame:
    """Cosine of every frame with its ``width // 2`` neighbours on either side.

    Frames travel in blocks with a halo, so a vector is copied to at most a few tasks rather
    than once per neighbour; inside a block one matrix product gives the whole band.
    Returns ``video_id, frame, similarity`` with ``width`` values, 0 outside the video.
    """
    if width % 2 != 1:
        raise ValueError("width must be odd")
    radius = width // 2
    block = max(block, radius)
    schema = T.StructType(
        [f for f in features.schema if f.name == "video_id"]
        + [
            T.StructField("frame", T.LongType()),
            T.StructField("similarity", T.ArrayType(T.DoubleType())),
        ]
    )

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["is_home"].any():
            # A block that only received its neighbours' edge rows.
            return pdf.iloc[:0][["video_id", "frame"]].assign(similarity=pd.Series(dtype=object))
        pdf = pdf.sort_values("frame", ignore_index=True)
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        m = m / np.maximum(norm, 1e-12)[:, None]
        frames = pdf["frame"].to_numpy()
        out = np.zeros((len(m), width))
        for k in range(-radius, radius + 1):
            a, b = max(0, -k), min(len(m), len(m) - k)
            if a < b:
                # A missing frame breaks adjacency; its slot stays 0.
                dots = np.einsum("ij,ij->i", m[a:b], m[a + k : b + k])
                out[a:b, k + radius] = np.where(frames[a + k : b + k] - frames[a:b] == k, dots, 0.0)
        home = pdf["is_home"].to_numpy()
        return pd.DataFrame(
            {"video_id": pdf["video_id"][home], "frame": frames[home], "similarity": list(out[home])}
        )

    haloed = with_halo(features.select("video_id", "frame", "embedding"), F.col("frame"), radius, block)
    return haloed.groupBy("video_id", "block").applyInPandas(band, schema)


def rgb_histogram(pixels: DataFrame) -> DataFrame:
    """512-bin colour histogram per frame, counts scaled to unit length.

    Counting combines map-side; the norm then sees at most 512 rows per frame.
    """
    counts = (
        pixels.select(
            "video_id",
            "frame",
            (
                F.shiftleft(F.shiftright(F.col("r").cast("int"), 5), 6)
                + F.shiftleft(F.shiftright(F.col("g").cast("int"), 5), 3)
                + F.shiftright(F.col("b").cast("int"), 5)
            ).alias("bin"),
        )
        .groupBy("video_id", "frame", "bin")
        .count()
    )
    squares = F.sum(F.col("count") * F.col("count")).over(Window.partitionBy("video_id", "frame"))
    return counts.withColumn("__sq", squares).select(
        "video_id", "frame", F.col("bin").cast("bigint").alias("bin"),
        (F.col("count").cast("double") / F.sqrt(F.col("__sq").cast("double"))).alias("weight"),
    )
