"""Row validation: every check adds ``violations ARRAY<STRING>``, empty when valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(**checks: Column) -> Column:
    """Names of the checks that do not hold; a check that is NULL does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )


def validate_chunks(df: DataFrame) -> DataFrame:
    """Needs the ranges, ``frame_count`` and ``source_total_frames``."""
    return df.withColumn(
        "violations",
        violations(
            context_order=F.col("context_end") >= F.col("context_start"),
            frame_count=F.col("frame_count") == F.col("context_end") - F.col("context_start") + 1,
            valid_inside=(F.col("context_start") <= F.col("valid_start"))
            & (F.col("valid_start") <= F.col("valid_end"))
            & (F.col("valid_end") <= F.col("context_end")),
            within_source=F.col("context_end") < F.col("source_total_frames"),
        ),
    )


def validate_transitions(df: DataFrame) -> DataFrame:
    """The tagged union ``hard_cut(frame, timestamp)`` or ``gradual_transition(4 fields)``."""
    hard = F.col("type") == "hard_cut"
    four = F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull()
    four = four & F.col("start_timestamp").isNotNull() & F.col("end_timestamp").isNotNull()
    return df.withColumn(
        "violations",
        violations(
            type=F.col("type").isin("hard_cut", "gradual_transition"),
            hard_fields=~hard | (F.col("frame").isNotNull() & F.col("timestamp").isNotNull()),
            gradual_fields=hard | four,
            order=hard | ~four | (F.col("end_frame") >= F.col("start_frame")),
            confidence=F.col("confidence").between(0.0, 1.0),
        ),
    )


def validate_scenes(scenes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scene order, and scenes inside the valid range of their chunk."""
    joined = scenes.join(
        chunks.select("video_id", "chunk_index", "valid_start", "valid_end"), ["video_id", "chunk_index"]
    )
    ordered = F.col("end_frame") >= F.col("start_frame")
    return joined.withColumn(
        "violations",
        violations(
            order=ordered,
            clipped=(F.col("valid_start") <= F.col("start_frame")) & (F.col("end_frame") <= F.col("valid_end")),
        ),
    )


def validate_cut_ownership(transitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The anchor lies in the chunk's valid range, or a gradual ends right before it."""
    joined = transitions.join(
        chunks.select("video_id", "chunk_index", "valid_start", "valid_end"), ["video_id", "chunk_index"]
    )
    owned = F.col("end_frame").between(F.col("valid_start"), F.col("valid_end")) | (
        (F.col("type") == "gradual_transition") & (F.col("end_frame") == F.col("valid_start") - 1)
    )
    return joined.withColumn("violations", violations(ownership=owned))


def validate_tracks(df: DataFrame) -> DataFrame:
    """B24."""
    return df.withColumn(
        "violations",
        violations(
            frame=F.col("frame") >= 0,
            track_id=F.col("track_id") >= 0,
            confidence=F.col("confidence").between(0.0, 1.0),
            origin=(F.col("x") >= 0) & (F.col("y") >= 0),
            extent=(F.col("width") > 0) & (F.col("height") > 0),
        ),
    )


def validate_frame_descriptor(df: DataFrame) -> DataFrame:
    """``shape ARRAY<BIGINT>`` and ``byte_length`` of an RGB tensor.

    Pass ``length(rgb)`` as ``byte_length``; the bytes themselves are not needed here.
    """
    shape = F.col("shape")
    product = F.aggregate(shape, F.lit(1).cast("bigint"), lambda acc, n: acc * n)
    four = F.size(shape) == 4
    return df.withColumn(
        "violations",
        violations(
            dimensions=four,
            frames=F.get(shape, F.lit(0)) > 0,
            channels=F.get(shape, F.lit(3)) == 3,
            bytes=F.col("byte_length") == product,
        ),
    )


def validate_source(df: DataFrame) -> DataFrame:
    """An upload needs its path, a URL source its URL, and never both."""
    path = F.coalesce(F.col("upload_path") != "", F.lit(False))
    url = F.coalesce(F.col("url") != "", F.lit(False))
    return df.withColumn(
        "violations",
        violations(
            kind=F.col("kind").isin("upload", "url"),
            upload=(F.col("kind") != "upload") | path,
            url=(F.col("kind") != "url") | url,
            exactly_one=path != url,
        ),
    )
