"""Per-chunk outputs to per-video results (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.operators.ordered import BLOCK, scan
from shotspark.operators.ownership import dedup_owned

CHUNK = ["video_id", "chunk_index"]
PIPELINE_VERSION = "1.3"
#: Frames covered by one result document; a longer video continues in further documents.
PART_FRAMES = 4_096


def merge_scenes(chunk_scenes: DataFrame) -> DataFrame:
    """A scene seen by several chunks spans all of them."""
    return chunk_scenes.groupBy("video_id", "scene_no").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")
    )


def merge_transitions(chunk_transitions: DataFrame) -> DataFrame:
    """One row per (type, start, end): highest confidence, earliest chunk on ties."""
    return dedup_owned(chunk_transitions)


def flatten_tracks(chunk_tracks: DataFrame, position: str | None = None) -> DataFrame:
    """One row per tracked box, in (frame, scene, track) order.

    The boxes of ``BLOCK`` frames of a video lie together, in order; no order holds between
    such parts, so nothing is sorted across the whole table.  With ``position`` a column of
    that name tells each box's place in the order of its whole video, from 0.
    """
    flat = chunk_tracks.select("video_id", F.inline("tracks"))
    if position:
        flat = scan(flat, ["video_id"], F.col("frame"), ["scene_no", "track_id"], rank=position)
    placed = flat.repartition("video_id", F.expr(f"frame div {BLOCK}"))
    return placed.sortWithinPartitions("video_id", "frame", "scene_no", "track_id")


def _ms(later: Column, earlier: Column) -> Column:
    us = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0.0), us / F.lit(1000.0))


def timings(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Measured times of a task and what remains unexplained.

    ``tasks(video_id, created_at, started_at, finished_at, aggregation_ms)``;
    ``chunks(video_id, decode_ms, cut_ms, tracking_ms)``.
    """
    sums = chunks.groupBy("video_id").agg(
        *[F.sum(c).alias(c) for c in ("decode_ms", "cut_ms", "tracking_ms")]
    )

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    rows = tasks.join(sums, "video_id", "left").select(
        "video_id",
        _ms(F.coalesce("started_at", "created_at"), F.col("created_at")).alias("queue_wait_ms"),
        zero("decode_ms").alias("decoding_ms"),
        zero("cut_ms").alias("cut_detection_ms"),
        zero("tracking_ms").alias("tracking_ms"),
        zero("aggregation_ms").alias("aggregation_ms"),
        _ms(F.col("finished_at"), F.col("created_at")).alias("total_ms"),
    )
    measured = F.expr("queue_wait_ms + decoding_ms + cut_detection_ms + tracking_ms + aggregation_ms")
    return rows.withColumn("orchestration_wait_ms", F.greatest(F.lit(0.0), F.col("total_ms") - measured))


def missing_output_warnings(chunks: DataFrame, cuts: DataFrame, tracking: DataFrame) -> DataFrame:
    """A warning for every chunk that lacks its cut output and one for its tracking output."""
    both = (
        chunks.select(*CHUNK)
        .distinct()
        .join(cuts.select(*CHUNK, F.lit(True).alias("c")).distinct(), CHUNK, "left")
        .join(tracking.select(*CHUNK, F.lit(True).alias("t")).distinct(), CHUNK, "left")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("c").isNull(), F.lit("no cut output")),
            F.when(F.col("t").isNull(), F.lit("no tracking output")),
        )
    )
    return both.select(*CHUNK, F.explode(found).alias("warning"))


def order_result(scenes: DataFrame, transitions: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Position of every scene (start, end, id) and transition (start, type) in its result."""
    s = scan(scenes, ["video_id"], F.col("start_frame"), ["end_frame", "scene_no"], width=block, rank="position")
    t = scan(transitions, ["video_id"], F.col("start_frame"), ["type", "end_frame"], width=block, rank="position")
    return s.select(
        "video_id", F.lit("scene").alias("kind"), "position", "start_frame", "end_frame"
    ).unionByName(t.select("video_id", F.col("type").alias("kind"), "position", "start_frame", "end_frame"))


def assemble_results(
    videos: DataFrame,
    scenes: DataFrame,
    transitions: DataFrame,
    tracks: DataFrame,
    timing: DataFrame,
    warnings: DataFrame,
    *,
    part_frames: int | None = PART_FRAMES,
) -> DataFrame:
    """Nested result documents, one per ``(video_id, part)``.

    A part covers ``part_frames`` frames, so the arrays stay bounded however long a video
    is; most videos have part 0 only.  With None there is one document per video, whatever
    its length.  Metadata, timings and warnings are on part 0, where
    warnings keep one entry per distinct text with its count.
    """

    def gather(df: DataFrame, frame: str, name: str, *fields: str) -> DataFrame:
        number = F.lit(0).cast("bigint") if part_frames is None else F.expr(f"{frame} div {part_frames}")
        part = number.alias("part")
        return df.groupBy("video_id", part).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    body = gather(scenes, "start_frame", "scenes", "start_frame", "end_frame", "scene_no")
    body = body.join(
        gather(transitions, "start_frame", "transitions", "start_frame", "type", "end_frame", "confidence"),
        ["video_id", "part"], "full_outer",
    ).join(
        gather(
            tracks, "frame", "tracks",
            "frame", "scene_no", "track_id", "class_name", "confidence", "x", "y", "width", "height",
        ),
        ["video_id", "part"], "full_outer",
    )
    counted = warnings.groupBy("video_id", "warning").agg(F.count(F.lit(1)).alias("chunks"))
    notes = counted.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("warning", "chunks"))).alias("warnings"))
    head = (
        videos.select("video_id", F.struct(*[c for c in videos.columns if c != "video_id"]).alias("video"))
        .join(timing.select("video_id", F.struct(*[c for c in timing.columns if c != "video_id"]).alias("timings")), "video_id", "left")
        .join(notes, "video_id", "left")
        .withColumn("part", F.lit(0).cast("bigint"))
    )
    none = {name: F.coalesce(name, F.array().cast(body.schema[name].dataType)) for name in ("scenes", "transitions", "tracks")}
    return (
        head.join(body, ["video_id", "part"], "full_outer")
        .withColumns(none)
        .withColumn("pipeline_version", F.lit(PIPELINE_VERSION))
        .select("video_id", "part", "pipeline_version", "video", "scenes", "transitions", "tracks", "timings", "warnings")
    )


SIZES = ("scenes", "transitions", "tracks")


def document_sizes(results: DataFrame) -> DataFrame:
    """Entries per video in the documents of :func:`assemble_results`; sizes add up over parts."""
    return results.groupBy("video_id").agg(*[F.sum(F.size(c)).alias(f"n_{c}") for c in SIZES])


def result_sizes(videos: DataFrame, scenes: DataFrame, transitions: DataFrame, tracks: DataFrame) -> DataFrame:
    """The same entries, counted in the tables that documents are assembled from.

    Counts combine map-side, so that no entry travels.
    """
    def counted(df: DataFrame, name: str | None) -> DataFrame:
        return df.groupBy("video_id").agg(*[(F.count(F.lit(1)) if c == name else F.lit(0).cast("bigint")).alias(f"n_{c}") for c in SIZES])

    parts = counted(videos, None)
    for name, df in zip(SIZES, (scenes, transitions, tracks), strict=True):
        parts = parts.unionByName(counted(df, name))
    return parts.groupBy("video_id").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in SIZES])


def outcome_cards(sizes: DataFrame, status: DataFrame) -> DataFrame:
    """Per task what its card shows; ``sizes`` come from :func:`document_sizes` or :func:`result_sizes`."""
    rows = status.join(sizes, "video_id", "left")
    done = F.col("n_scenes").isNotNull() & (F.col("stage") != "failed")
    text = F.concat_ws(
        " · ",
        F.concat(F.col("n_scenes").cast("string"), F.lit(" scenes")),
        F.concat(F.col("n_transitions").cast("string"), F.lit(" transitions")),
        F.concat(F.col("n_tracks").cast("string"), F.lit(" detections")),
    )
    problem = F.coalesce(
        F.nullif("error_detail", F.lit("")), F.nullif("message", F.lit("")), F.lit("failed without detail")
    )
    return rows.select("video_id", done.alias("completed"), F.when(done, text).otherwise(problem).alias("card"))


def outcome_totals(cards: DataFrame) -> DataFrame:
    """Completed and failed totals."""
    return cards.agg(F.count_if("completed").alias("completed"), F.count_if(~F.col("completed")).alias("failed"))


def transition_counts(chunk_transitions: DataFrame) -> DataFrame:
    """J9."""
    return chunk_transitions.groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("transitions"),
        F.count_if(F.col("type") == "hard_cut").alias("hard_cuts"),
        F.count_if(F.col("type") == "gradual_transition").alias("graduals"),
    )


def collect_chunk_payloads(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """Stored chunks with an index below the task's total."""
    return chunks.join(totals.select("video_id", "total_chunks"), "video_id").where(
        "chunk_index >= 0 and chunk_index < total_chunks"
    ).drop("total_chunks")

