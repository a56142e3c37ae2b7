"""Queries a viewer runs on finished results (K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.operators.ordered import BLOCK, locate, scan

TRACK = ["video_id", "scene_no", "track_id"]
#: Ten minutes in microseconds: block width on the time axis of a video.
TEN_MINUTES = 600_000_000


def _us(seconds: Column) -> Column:
    return F.floor(seconds * 1_000_000).cast("bigint")


def scenes_in_seconds(scenes: DataFrame, videos: DataFrame, default_fps: float | None = None) -> DataFrame:
    """K1: scene bounds in seconds; ``default_fps`` replaces a missing rate."""
    fps = _rate(default_fps)
    return scenes.join(videos.select("video_id", "fps"), "video_id").select(
        "video_id", "scene_no",
        F.try_divide(F.col("start_frame").cast("double"), fps).alias("start"),
        F.try_divide(F.col("end_frame").cast("double"), fps).alias("end"),
    )


def _rate(default_fps: float | None) -> Column:
    return F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(default_fps).cast("double"))


def cuts_in_seconds(transitions: DataFrame, videos: DataFrame, default_fps: float | None = None) -> DataFrame:
    """K2: start and end of every transition; stored timestamps win over frames.

    ``default_fps`` replaces a missing or zero rate; without one the times are NULL.  Needs ``type, frame, timestamp, start_frame, end_frame, start_timestamp, end_timestamp,
    confidence``.
    """
    fps = _rate(default_fps)

    def seconds(stamp: Column, *frames: Column) -> Column:
        return F.coalesce(stamp, F.try_divide(F.coalesce(*frames, F.lit(0)).cast("double"), fps))

    gradual = F.col("type") == "gradual_transition"
    hard = seconds(F.col("timestamp"), F.col("frame"))
    start = F.when(gradual, seconds(F.col("start_timestamp"), F.col("start_frame"))).otherwise(hard)
    end = F.when(gradual, seconds(F.col("end_timestamp"), F.col("end_frame"), F.col("start_frame"))).otherwise(hard)
    keep = [c for c in transitions.columns if c in ("transition_id",)]
    return transitions.join(videos.select("video_id", "fps"), "video_id").select(
        "video_id", *keep, "type", start.alias("start"), end.alias("end"),
        F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence"),
    )


def track_keyframes(
    tracks: DataFrame, videos: DataFrame, *, block: int = BLOCK, default_fps: float | None = None,
    default_size: tuple[int, int] | None = None,
) -> DataFrame:
    """K3: the boxes of each track in frame order, scaled to the frame: one row per keyframe.

    ``k`` numbers the keyframes of a track; rows stay flat because a track may be as long
    as its scene.  ``videos`` gives ``fps, width, height``; the defaults replace missing or
    zero ones, and without defaults what they would scale is NULL.
    """
    across, down = default_size or (None, None)
    v = videos.select(
        "video_id", _rate(default_fps).alias("__fps"),
        F.coalesce(F.nullif("width", F.lit(0)), F.lit(across).cast("int")).alias("__w"),
        F.coalesce(F.nullif("height", F.lit(0)), F.lit(down).cast("int")).alias("__h"),
    )
    rows = scan(tracks, TRACK, F.col("frame"), width=block, rank="k")
    return rows.join(v, "video_id").select(
        *TRACK, "k", "frame",
        F.try_divide(F.col("frame").cast("double"), F.col("__fps")).alias("t"),
        F.try_divide(F.col("x"), F.col("__w")).alias("x"),
        F.try_divide(F.col("y"), F.col("__h")).alias("y"),
        F.try_divide(F.col("width"), F.col("__w")).alias("w"),
        F.try_divide(F.col("height"), F.col("__h")).alias("h"),
        "confidence", "class_name",
    )


def track_summary(keyframes: DataFrame) -> DataFrame:
    """K3: class and confidence of a track are those of its first keyframe (0.8 if absent)."""
    kf = F.struct("t", "x", "y", "w", "h", "confidence")
    return keyframes.groupBy(*TRACK).agg(
        F.min_by("class_name", "k").alias("class_name"),
        F.min_by(kf, "k").alias("first"),
        F.max_by(kf, "k").alias("last"),
        F.count(F.lit(1)).alias("keyframes"),
    ).withColumn("confidence", F.coalesce("first.confidence", F.lit(0.8)))


def video_duration(videos: DataFrame, scenes_sec: DataFrame, keyframes: DataFrame, default: float = 12.0) -> DataFrame:
    """K4: stored duration, else the player's, else the last thing seen, else a default."""
    ends = scenes_sec.groupBy("video_id").agg(F.max("end").alias("scene_end"))
    last = keyframes.groupBy("video_id").agg(F.max("t").alias("last_t"))
    inferred = F.greatest(F.lit(0.0), F.coalesce("scene_end", F.lit(0.0)), F.coalesce("last_t", F.lit(0.0)))
    zero = F.lit(0.0)
    return videos.join(ends, "video_id", "left").join(last, "video_id", "left").select(
        "video_id",
        F.coalesce(
            F.nullif("duration_seconds", zero), F.nullif("player_duration", zero), F.nullif(inferred, zero), F.lit(default)
        ).alias("duration"),
    )


def scene_at(scenes_sec: DataFrame, times: DataFrame, gap: str = "reference") -> DataFrame:
    """K6: the scene shown at each time ``(video_id, t)``.

    Outside every scene ``gap='reference'`` shows the last scene of the video and
    ``gap='hold'`` the latest scene that has started.
    """
    s = scenes_sec.select("video_id", "scene_no", F.col("start").alias("__from"), F.col("end").alias("__to"))
    if gap == "hold":
        # Stretch each scene to the next start; the last one stays open.
        follows = scan(s, ["video_id"], F.col("scene_no"), previous={"__before": F.col("__from")})
        nxt = follows.where("__before is not null").select("video_id", F.col("__before").alias("__from"), F.col("__from").alias("__until"))
        s = s.join(nxt, ["video_id", "__from"], "left")
        last_t = times.groupBy("video_id").agg(F.max("t").alias("__last_t"))
        s = s.join(last_t, "video_id", "left")
        s = s.withColumn("__to", F.coalesce("__until", F.greatest("__to", "__last_t"))).drop("__until", "__last_t")
        return locate(times, s, ["video_id"], "t", "__from", "__to", ["scene_no"], how="left", width=TEN_MINUTES, axis=_us).drop("__from", "__to")
    hit = locate(times, s, ["video_id"], "t", "__from", "__to", ["scene_no"], how="left", width=TEN_MINUTES, axis=_us)
    last = scenes_sec.groupBy("video_id").agg(F.max_by("scene_no", F.struct("start", "scene_no")).alias("__last"))
    return hit.join(last, "video_id", "left").select(
        *times.columns, F.coalesce("scene_no", "__last").alias("scene_no")
    )


def detections_at(keyframes: DataFrame, scenes_sec: DataFrame, times: DataFrame, gap: str = "reference") -> DataFrame:
    """K5: every track of the scene shown at ``t``, interpolated between its keyframes.

    ``times(video_id, t)`` distinct.  Before its first and after its last keyframe a track
    holds that box.  Keyframe pairs are intervals of a track; a time finds its pair by an
    ordered merge per track.
    """
    shown = scene_at(scenes_sec, times.select("video_id", "t"), gap)
    ends = track_summary(keyframes)
    asked = shown.join(ends, ["video_id", "scene_no"])
    box = ["x", "y", "w", "h", "confidence"]
    pairs = scan(
        keyframes.select(*TRACK, "k", "t", *box), TRACK, F.col("k"),
        previous={"a": F.struct("t", *box)},
    ).where("a is not null")
    pairs = pairs.select(*TRACK, F.col("a.t").alias("__a"), F.col("t").alias("__b"), "a", F.struct("t", *box).alias("b"))
    found = locate(
        asked, pairs, TRACK, "t", "__a", "__b", ["a", "b"], how="left",
        width=TEN_MINUTES, axis=_us, after_start=True,
    ).drop("__a", "__b")
    a = F.coalesce(F.col("a"), F.when(F.col("t") > F.col("last.t"), F.col("last")).otherwise(F.col("first")))
    b = F.coalesce(F.col("b"), F.when(F.col("t") > F.col("last.t"), F.col("last")).otherwise(F.col("first")))
    # Outside the keyframes both ends are the same box and the share does not matter.
    span = F.when(b["t"] == a["t"], F.lit(1.0)).otherwise(b["t"] - a["t"])
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - a["t"]) / span))
    return found.select(
        "video_id", "t", "scene_no", "track_id", "class_name",
        *[(a[c] + (b[c] - a[c]) * share).alias(c) for c in box],
    )


def class_counts(tracks: DataFrame) -> DataFrame:
    """K7: tracks (not boxes) per class and video; a track's class is its first box's."""
    first = tracks.groupBy(*TRACK).agg(F.min_by("class_name", "frame").alias("class_name"))
    return first.groupBy("video_id", "class_name").agg(F.count(F.lit(1)).alias("tracks"))


def visible_only(dets: DataFrame, classes: Sequence[str] | DataFrame | None) -> DataFrame:
    """K8: boxes of the visible classes; ``None`` shows everything."""
    if classes is None:
        return dets
    if isinstance(classes, DataFrame):
        return dets.join(classes.select("class_name"), "class_name", "left_semi")
    return dets.where(F.col("class_name").isin(*classes))


def split_cuts_by_type(cuts_sec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of hard cuts and bands of graduals."""
    points = cuts_sec.where("type = 'hard_cut'").select("video_id", F.col("start").alias("t"), "confidence")
    bands = cuts_sec.where("type = 'gradual_transition'").select("video_id", "start", "end", "confidence")
    return points, bands
