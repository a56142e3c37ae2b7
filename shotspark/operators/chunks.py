"""Chunk planning: overlapping frame ranges bounded by memory (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Plan rows are generated in pieces of this many chunks or windows.
PIECE = 10_000


def effective_chunking(
    videos: DataFrame, size: int = 64, overlap: int = 16, max_bytes: int | None = 80 * 1024 * 1024
) -> DataFrame:
    """Add ``chunk_size`` and ``overlap`` that keep one decoded chunk within ``max_bytes``.

    Both are NULL where a single frame is already too large or has no size.
    """
    if max_bytes is None:
        return videos.withColumns(
            {"chunk_size": F.lit(size).cast("bigint"), "overlap": F.lit(overlap).cast("bigint")}
        )
    frames = F.expr(f"{max_bytes}L div nullif(greatest(cast(width as bigint) * height * 3, 0L), 0L)")
    sized = videos.withColumn("__m", frames)
    m = F.col("__m")
    ov = F.least(F.lit(overlap).cast("bigint"), F.expr("__m div 4"))
    cs = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(size).cast("bigint"), m - ov))
    return sized.withColumns(
        {
            "chunk_size": F.when(m == 1, F.lit(1).cast("bigint")).when(m > 1, cs),
            "overlap": F.when(m == 1, F.lit(0).cast("bigint")).when(m > 1, F.least(ov, cs - 1)),
        }
    ).drop("__m")


def _numbers(df: DataFrame, count: str, name: str) -> DataFrame:
    """One row per ``name`` in ``0 .. count - 1``, spread over tasks for long videos."""
    zero, piece = F.lit(0).cast("bigint"), F.lit(PIECE).cast("bigint")
    return (
        df.where(F.col(count) > 0)
        .withColumn("__from", F.explode(F.sequence(zero, F.col(count) - 1, piece)))
        .repartition("video_id", "__from")
        .withColumn(
            name, F.explode(F.sequence("__from", F.least(F.col(count) - 1, F.col("__from") + PIECE - 1)))
        )
        .drop("__from")
    )


def plan_chunks(videos: DataFrame) -> DataFrame:
    """The chunks of every video that has ``frame_count, chunk_size, overlap``."""
    counted = videos.select(
        "video_id", "frame_count", "chunk_size", "overlap",
        F.expr("(frame_count + chunk_size - 1) div chunk_size").alias("total_chunks"),
    )
    start = F.col("chunk_index") * F.col("chunk_size")
    end = F.least(start + F.col("chunk_size"), F.col("frame_count")) - 1
    return _numbers(counted, "total_chunks", "chunk_index").select(
        "video_id",
        "chunk_index",
        F.greatest(F.lit(0).cast("bigint"), start - F.col("overlap")).alias("context_start"),
        end.alias("context_end"),
        start.alias("valid_start"),
        end.alias("valid_end"),
        (end == F.col("frame_count") - 1).alias("is_last"),
        "total_chunks",
    )


def assign_frames_to_chunks(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """D3: one row per (frame, chunk whose context covers it).

    The overlap is below the chunk size, so a frame belongs to its own chunk and at most to
    the next one; the chunk numbers follow by arithmetic and no interval join is needed.
    """
    plan = videos.select("video_id", "frame_count", "chunk_size", "overlap")
    own = F.expr("frame div chunk_size")
    nxt = (own + 1) * F.col("chunk_size")
    also = (nxt < F.col("frame_count")) & (F.col("frame") >= nxt - F.col("overlap"))
    return (
        frames.join(plan, "video_id")
        .where("frame >= 0 and frame < frame_count")
        .withColumn("chunk_index", F.explode(F.array_compact(F.array(own, F.when(also, own + 1)))))
        .withColumn(
            "local_frame",
            F.col("frame")
            - F.greatest(F.lit(0).cast("bigint"), F.col("chunk_index") * F.col("chunk_size") - F.col("overlap")),
        )
        .drop("frame_count", "chunk_size", "overlap")
    )


def remaining_chunks(plan: DataFrame, published: DataFrame) -> DataFrame:
    """The planned chunks that were not published yet."""
    return plan.join(published.select("video_id", "chunk_index"), ["video_id", "chunk_index"], "left_anti")


def plan_model_windows(videos: DataFrame, window: int = 100, overlap: int = 20) -> DataFrame:
    """Windows of the shot model; the last one is the first that reaches the end."""
    step = window - overlap
    counted = videos.select(
        "video_id", "frame_count",
        F.when(F.col("frame_count") <= window, F.lit(1).cast("bigint"))
        .otherwise(F.expr(f"(frame_count - {window} + {step} - 1) div {step} + 1")).alias("windows"),
    )
    start = F.col("window_no") * step
    return _numbers(counted, "windows", "window_no").select(
        "video_id", "window_no",
        start.alias("start_frame"),
        (F.least(start + window, F.col("frame_count")) - 1).alias("end_frame"),
    )


def pad_windows(windows: DataFrame, window: int = 100) -> DataFrame:
    """The frame shown in each slot of a window, the last frame repeated as padding."""
    slots = windows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(window - 1).cast("bigint"))))
    wanted = F.col("start_frame") + F.col("slot")
    return slots.select(
        "video_id", "window_no", "slot",
        F.least(wanted, F.col("end_frame")).alias("frame"),
        (wanted > F.col("end_frame")).alias("is_padding"),
    )


def check_chunk_frames(chunk_frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks whose number of frame rows differs from their context length."""
    counts = chunk_frames.groupBy("video_id", "chunk_index").agg(F.count(F.lit(1)).alias("frames"))
    expected = (F.col("context_end") - F.col("context_start") + 1).alias("expected")
    return plan.select("video_id", "chunk_index", expected).join(
        counts, ["video_id", "chunk_index"], "left"
    ).select(
        "video_id", "chunk_index", "expected", F.coalesce("frames", F.lit(0)).alias("frames"),
        (F.coalesce("frames", F.lit(0)) == F.col("expected")).alias("complete"),
    )
