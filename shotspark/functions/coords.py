"""Scalar functions on frame rates, frame coordinates and identifiers (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rational(raw: Column) -> Column:
    """``"30000/1001"`` or a plain number as DOUBLE; NULL if malformed or divided by zero."""
    parts = F.split(F.trim(raw), "/")
    number = F.try_divide(
        F.get(parts, F.lit(0)).try_cast("double"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"),
    )
    return F.when(F.size(parts) <= 2, number)


def parse_fps(avg: Column, r: Column) -> Column:
    """The first of two frame-rate strings that is a positive rational."""

    def usable(raw: Column) -> Column:
        value = _rational(F.when(~raw.isin("", "0/0"), raw))
        return F.when(value > 0, value)

    return F.coalesce(usable(avg), usable(r))


def positive(value: Column, kind: str) -> Column:
    """The value as ``kind`` if it parses and is above zero, else NULL."""
    parsed = value.try_cast(kind)
    return F.when(parsed > 0, parsed)


def frame_count_or(nb_frames: Column, nb_read_frames: Column) -> Column:
    """Container frame count, else the counted one."""
    return F.coalesce(positive(nb_frames, "bigint"), positive(nb_read_frames, "bigint"))


def duration_or(stream: Column, fmt: Column, frame_count: Column, fps: Column) -> Column:
    """Stream duration, else format duration, else frames over rate."""
    return F.coalesce(
        positive(stream, "double"), positive(fmt, "double"), F.try_divide(frame_count.cast("double"), fps)
    )


def frame_to_ts(frame: Column, fps: Column, digits: int | None = None) -> Column:
    """C3."""
    seconds = F.try_divide(frame.cast("double"), fps)
    return seconds if digits is None else F.bround(seconds, digits)


def local_to_global(context_start: Column, local: Column, frame_count: Column) -> Column:
    """C4: NULL where the local index lies outside the chunk."""
    return F.when((local >= 0) & (local < frame_count), context_start + local)


def resample_index_map(videos: DataFrame, target_fps: int = 25, *, piece: int = 10_000) -> DataFrame:
    """Tick ``k`` of the target rate shows frame ``ceil(k * fps / target)``.

    The rate stays a fraction (``fps_num``/``fps_den``), so the map is exact.  Ticks are
    generated in pieces: one long video never expands from a single row in one task.
    """
    last = F.expr(f"((frame_count - 1) * fps_den * {target_fps}L) div fps_num")
    pieces = videos.where("frame_count > 0 and fps_num > 0 and fps_den > 0").withColumn("__last", last)
    pieces = pieces.withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"), F.lit(piece).cast("bigint")))
    )
    return (
        pieces.repartition("video_id", "__from")
        .withColumn(
            "tick", F.explode(F.sequence("__from", F.least(F.col("__last"), F.col("__from") + piece - 1)))
        )
        .withColumn(
            "frame",
            F.expr(f"(tick * fps_num + {target_fps}L * fps_den - 1) div ({target_fps}L * fps_den)"),
        )
        .select("video_id", "tick", "frame")
    )


def rescale_annotations(ann: DataFrame, videos: DataFrame, target_fps: float = 30.0) -> DataFrame:
    """Annotated ranges to another frame rate, halves rounded to even.

    A one-frame step stays one frame; a range that collapses becomes two frames long.
    Videos without a positive rate drop out.
    """
    rated = ann.join(videos.where("fps > 0").select("video_id", "fps"), "video_id")
    ratio = F.lit(float(target_fps)) / F.col("fps")

    def scaled(col: str) -> Column:
        return F.bround(F.col(col).cast("double") * ratio).cast("bigint")

    rated = rated.select(
        *ann.columns,
        scaled("frame_num").alias("__n"),
        scaled("start_frame").alias("__s"),
        scaled("end_frame").alias("__e"),
    )
    end = (
        F.when(F.col("end_frame") - F.col("start_frame") == 1, F.col("__s") + 1)
        .when(F.col("__e") <= F.col("__s"), F.col("__s") + 2)
        .otherwise(F.col("__e"))
    )
    keep = [c for c in ann.columns if c not in ("start_frame", "end_frame", "frame_num")]
    return rated.select(
        *keep,
        F.least(F.col("__s"), F.col("__n") - 1).alias("start_frame"),
        F.least(end, F.col("__n")).alias("end_frame"),
        F.col("__n").alias("frame_num"),
    )


def letterbox_geometry(width: Column, height: Column, target_width: int = 48, target_height: int = 27) -> Column:
    """Padding that gives a frame the target's aspect: ``STRUCT<pad_x, pad_y>``.

    Both are NULL for a frame without a positive size.
    """
    aspect = F.lit(target_width / target_height)
    frame_aspect = F.when((width > 0) & (height > 0), F.try_divide(width.cast("double"), height.cast("double")))
    pad_y = F.floor((F.floor(width / aspect).cast("bigint") - height) / F.lit(2)).cast("bigint")
    pad_x = F.floor((F.floor(height * aspect).cast("bigint") - width) / F.lit(2)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(frame_aspect < aspect, pad_x).when(frame_aspect >= aspect, zero).alias("pad_x"),
        F.when(frame_aspect > aspect, pad_y).when(frame_aspect <= aspect, zero).alias("pad_y"),
    )


def normalise_bbox(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel box to fractions of the frame; NULL where the frame has no size."""
    return F.struct(
        F.try_divide(x, width).alias("x"), F.try_divide(y, height).alias("y"),
        F.try_divide(w, width).alias("w"), F.try_divide(h, height).alias("h"),
    )


def chunk_id(task: Column, index: Column) -> Column:
    """C11: ``task:00000007``."""
    return F.format_string("%s:%08d", task.cast("string"), index)


def scene_id(task: Column, number: Column) -> Column:
    """C11: ``task:scene:7``."""
    return F.concat_ws(":", task.cast("string"), F.lit("scene"), number.cast("string"))


def scene_ordinal(scene: Column) -> Column:
    """C11: the last ``:`` segment as a number; NULL if it is none."""
    return F.element_at(F.split(scene, ":"), -1).try_cast("bigint")


def canonical_chunk_key(task: Column, chunk: Column) -> Column:
    """``task:chunk`` whether or not the chunk id already carries its task."""
    prefix = F.concat(task.cast("string"), F.lit(":"))
    bare = F.when(F.startswith(chunk, prefix), F.substr(chunk, F.length(prefix) + 1)).otherwise(chunk)
    return F.concat(prefix, bare)
