"""Ownership of transitions across chunk borders, and scenes (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.operators.ordered import BLOCK, islands, locate, previous_dense, scan
from shotspark.session import durable

CHUNK = ["video_id", "chunk_index"]


def globalise(detections: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk-local frames to video frames, confidence clamped to [0, 1].

    ``in_range`` is false where the local range leaves the chunk's tensor; the ownership
    rules take no such row.  The chunk's columns stay attached for them.
    """
    joined = detections.join(
        chunks.select(
            *CHUNK, "context_start", "context_end", "valid_start", "valid_end", "is_last"
        ),
        CHUNK,
    )
    size = F.col("context_end") - F.col("context_start") + 1
    return joined.select(
        *CHUNK,
        "type",
        (F.col("context_start") + F.col("local_start")).alias("start_frame"),
        (F.col("context_start") + F.col("local_end")).alias("end_frame"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"),
        (
            (F.col("local_start") >= 0)
            & (F.col("local_start") <= F.col("local_end"))
            & (F.col("local_end") < size)
        ).alias("in_range"),
        "context_start", "context_end", "valid_start", "valid_end", "is_last",
    )


def own_hard(global_detections: DataFrame) -> DataFrame:
    """a hard cut belongs to the one chunk whose valid range holds its frame."""
    return global_detections.where(
        "in_range and type = 'hard_cut' and end_frame between valid_start and valid_end"
    )


def chunk_gradual_summary(graduals: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the deferral rules need to know about each chunk, one row per chunk.

    ``cand`` is the first gradual (by start, then end) that spans the border before the
    chunk; ``open_start``/``open_conf`` summarise the graduals that touch the chunk's last
    frame and therefore stay pending.  Whether something is pending after a chunk depends on
    this chunk alone; only its start and confidence can reach back, and only while each
    chunk is spanned completely by its candidate.
    """
    opens = "end_frame = context_end and not is_last"
    border = F.col("valid_start") - 1
    g = graduals.where("in_range and type = 'gradual_transition'")
    cand_row = F.when(
        (F.col("start_frame") <= border) & (border <= F.col("end_frame")),
        F.struct("start_frame", "end_frame", (-F.col("confidence")).alias("neg_conf")),
    )
    per_chunk = g.groupBy(*CHUNK).agg(
        F.min(cand_row).alias("cand"),
        F.min(F.when(F.expr(opens), F.col("start_frame"))).alias("open_start"),
        F.max(F.when(F.expr(opens), F.col("confidence"))).alias("open_conf"),
    )
    return chunks.select(*CHUNK, "valid_start", "context_end", "is_last").join(per_chunk, CHUNK, "left")


def _with_links(graduals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk summaries plus ``before_open`` (was anything pending?) and ``continues``."""
    rows = previous_dense(
        chunk_gradual_summary(graduals, chunks), ["video_id"], "chunk_index", {"before_open": "open_start"}
    )
    spans = F.coalesce((F.col("cand.end_frame") == F.col("context_end")) & ~F.col("is_last"), F.lit(False))
    return rows.withColumn("continues", F.col("before_open").isNotNull() & spans)


def own_gradual(global_detections: DataFrame, chunks: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """graduals with deferral over chunk borders, without folding a video in one task.

    Chunks linked by a spanning candidate form a chain; a chain's pending range is the
    minimum start and maximum confidence over its chunks and is settled by the chunk after
    it.  On a doubled index axis a link closes the gap between two chunks, so chains are
    islands.  Returns what each chunk emits: ``video_id, chunk_index, start_frame,
    end_frame, confidence``.  Chunks of a video must be complete and numbered from 0, and a
    chunk must not report the same range twice.
    """
    graduals = global_detections.where("in_range and type = 'gradual_transition'")
    links = _with_links(graduals, chunks)
    twice = F.col("chunk_index") * 2
    chains = islands(
        links.where("open_start is not null"), ["video_id"],
        twice - F.when(F.col("continues"), 1).otherwise(0), twice, width=2 * block,
        maxes={"neg_start": -F.col("open_start"), "before_conf": F.col("open_conf")},
    ).select(
        "video_id",
        (F.expr("end div 2") + 1).alias("chunk_index"),
        (-F.col("neg_start")).alias("before_start"),
        "before_conf",
    )
    no_cand = F.col("cand").isNull()
    resolved = links.join(chains, CHUNK).select(
        *CHUNK,
        F.when(no_cand, F.col("before_start"))
        .otherwise(F.least("before_start", F.col("cand.start_frame"))).alias("start_frame"),
        F.when(no_cand, F.col("valid_start") - 1).otherwise(F.col("cand.end_frame")).alias("end_frame"),
        F.when(no_cand, F.col("before_conf"))
        .otherwise(F.greatest("before_conf", -F.col("cand.neg_conf"))).alias("confidence"),
    )
    # Everything else a chunk saw: closed inside it, and not used up as the candidate.
    used = links.where("before_open is not null and cand is not null").select(
        *CHUNK, F.col("cand.start_frame").alias("start_frame"), F.col("cand.end_frame").alias("end_frame")
    )
    plain = (
        graduals.where("end_frame between valid_start and valid_end")
        .where("not (end_frame = context_end and not is_last)")
        .join(used, [*CHUNK, "start_frame", "end_frame"], "left_anti")
        .select(*CHUNK, "start_frame", "end_frame", "confidence")
    )
    return resolved.unionByName(plain)


def pending_after(global_detections: DataFrame, chunks: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The deferred gradual after each chunk: ``pending_start, pending_conf`` (or NULL).

    Inside a chain the state is a running minimum and maximum.  A chain's first chunk
    dominates all earlier chains, so one ordered maximum over ``(chain, value)`` restarts
    by itself at every chain.
    """
    links = durable(_with_links(global_detections, chunks))
    rows = scan(
        links.withColumn("__head", F.when(~F.col("continues"), F.col("chunk_index"))),
        ["video_id"], F.col("chunk_index"), width=block, maxes={"chain": F.col("__head")},
    )
    here = F.col("open_start").isNotNull()
    rows = scan(
        rows, ["video_id"], F.col("chunk_index"), width=block,
        maxes={
            "__s": F.when(here, F.struct(F.col("chain"), (-F.col("open_start")).alias("v"))),
            "__c": F.when(here, F.struct(F.col("chain"), F.col("open_conf").alias("v"))),
        },
    )
    return rows.select(
        *CHUNK,
        F.when(here, -F.col("__s.v")).alias("pending_start"),
        F.when(here, F.col("__c.v")).alias("pending_conf"),
    )


def dedup_owned(owned: DataFrame) -> DataFrame:
    """per (type, start, end) the highest confidence, the earliest chunk on ties."""
    best = F.max_by(F.struct("chunk_index", "confidence"), F.struct("confidence", -F.col("chunk_index")))
    return (
        owned.groupBy("video_id", "type", "start_frame", "end_frame")
        .agg(best.alias("b"))
        .select("video_id", "type", "start_frame", "end_frame", "b.chunk_index", "b.confidence")
    )


def suppress_owned(hard: DataFrame, gradual: DataFrame) -> DataFrame:
    """drop hard cuts inside a gradual that the same chunk owns.

    A chunk is at most a few hundred frames long, so its graduals fit one short array.
    """
    ranges = gradual.groupBy(*CHUNK).agg(F.collect_list(F.struct("start_frame", "end_frame")).alias("__g"))
    inside = F.exists("__g", lambda g: F.col("end_frame").between(g["start_frame"], g["end_frame"]))
    return hard.join(ranges, CHUNK, "left").where(~F.coalesce(inside, F.lit(False))).select(*hard.columns)


def build_scenes(transitions: DataFrame, videos: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """scenes tile ``[0, frame_count - 1]``; the scene number of a frame is the number
    of transitions that end before it.

    Transitions need ``video_id, type, start_frame, end_frame``; videos ``frame_count``.
    """
    t = transitions.select("video_id", "end_frame", "start_frame", "type")
    cut = scan(
        t, ["video_id"], F.col("end_frame"), ["start_frame", "type"], width=block,
        rank="scene_no", previous={"prev_end": F.col("end_frame")},
    )
    ended = cut.select(
        "video_id", "scene_no",
        F.coalesce(F.col("prev_end") + 1, F.lit(0)).alias("start_frame"),
        "end_frame",
    )
    tails = videos.select("video_id", "frame_count").join(
        t.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_frame").alias("last_end")),
        "video_id", "left",
    ).select(
        "video_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("scene_no"),
        F.coalesce(F.col("last_end") + 1, F.lit(0)).cast("bigint").alias("start_frame"),
        (F.col("frame_count") - 1).alias("end_frame"),
    )
    return ended.unionByName(tails).where("start_frame <= end_frame")


def chunk_scenes(scenes: DataFrame, chunks: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """scenes clipped to each chunk's valid range.

    Both families tile the video, so their common refinement starts exactly at the scene
    starts and the chunk starts; each start looks up the scene and the chunk that hold it.
    """
    starts = (
        scenes.select("video_id", F.col("start_frame").alias("frame"))
        .unionByName(chunks.select("video_id", F.col("valid_start").alias("frame")))
        .distinct()
    )
    s = scenes.select("video_id", F.col("start_frame").alias("s_start"), F.col("end_frame").alias("s_end"), "scene_no")
    c = chunks.select("video_id", F.col("valid_start").alias("c_start"), F.col("valid_end").alias("c_end"), "chunk_index")
    both = locate(starts, s, ["video_id"], "frame", "s_start", "s_end", ["scene_no"], width=block)
    both = locate(both, c, ["video_id"], "frame", "c_start", "c_end", ["chunk_index"], width=block)
    return both.select(
        "video_id", "chunk_index", "scene_no",
        F.col("frame").alias("start_frame"),
        F.least("s_end", "c_end").alias("end_frame"),
    )


def chunk_scene_state(owned: DataFrame, pending: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """F8: ``(next_chunk, active_scene_no, pending_start, pending_conf)`` after each chunk.

    ``owned`` are the transitions by owning chunk, ``pending`` comes from
    :func:`pending_after` and has one row per chunk.
    """
    per_chunk = owned.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n"))
    rows = pending.join(per_chunk, CHUNK, "left")
    counted = scan(
        rows, ["video_id"], F.col("chunk_index"), width=block,
        sums={"active_scene_no": F.coalesce("n", F.lit(0))},
    )
    return counted.select(
        *CHUNK,
        (F.col("chunk_index") + 1).alias("next_chunk"),
        "active_scene_no",
        "pending_start",
        F.coalesce("pending_conf", F.lit(0.0)).alias("pending_conf"),
    )


def require_in_order(chunks: DataFrame, position: str = "position", *, block: int = BLOCK) -> DataFrame:
    """flag chunks whose index is not one more than the previous one's (first: 0)."""
    seen = scan(
        chunks, ["video_id"], F.col(position), width=block, previous={"__prev": F.col("chunk_index")}
    )
    expected = F.coalesce(F.col("__prev") + 1, F.lit(0)).cast("bigint")
    return seen.withColumn("expected", expected).withColumn(
        "in_order", F.col("chunk_index") == F.col("expected")
    ).drop("__prev")


def cached_or_compute(inputs: DataFrame, cache: DataFrame, compute, keys=("video_id", "chunk_index")) -> DataFrame:
    """reuse stored results, compute only what the cache lacks."""
    keys = list(keys)
    missing = inputs.join(cache.select(*keys), keys, "left_anti")
    reused = cache.join(inputs.select(*keys).distinct(), keys, "left_semi")
    return reused.unionByName(compute(missing), allowMissingColumns=True)
