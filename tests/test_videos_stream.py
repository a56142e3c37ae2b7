"""Chunks of live videos give what the batch operators give for whole ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog import scenes as cat
from shotspark.catalog.chunking import small_plan
from shotspark.operators import ownership as own
from shotspark.operators.fusion import class_nms
from shotspark.operators.tracking import TrackParams, assign_scene, associate_tracks
from shotspark.plans.tracks import coupled, number_tracks
from shotspark.session import durable
from shotspark.streaming.videos import videos_stream

CHUNK = ["video_id", "chunk_index"]


@pytest.fixture(scope="module")
def given(spark, sf):
    """Reports of the small plan's chunks, and boxes squeezed onto the frames of its videos."""
    few = F.col("video_id") < 6
    found, plan = cat.global_detections(spark, sf).where(few), durable(small_plan(spark, sf).where(few))
    size = fx.videos(spark, sf).where(few).select("video_id", "frame_count", "width", "height")
    moved = fx.detections(spark, sf).join(size.select("video_id", "frame_count"), "video_id")
    moved = moved.withColumn("frame", F.col("frame") % F.col("frame_count")).drop("frame_count")
    order = Window.partitionBy("video_id", "frame").orderBy("detector", "conf", "x1", "y1", "x2", "class_name", "det_idx")
    boxes = durable(class_nms(moved.withColumn("det_idx", F.row_number().over(order).cast("bigint"))))
    return found, plan, size, boxes


def messages(given):
    found, plan, size, boxes = given
    kinds = {"hard_cut": F.struct(F.col("end_frame").alias("frame"), "confidence"), "gradual_transition": F.struct("start_frame", "end_frame", "confidence")}
    out = plan.join(size.select("video_id", "width", "height"), "video_id")
    for name, (kind, row) in zip(("cuts", "graduals"), kinds.items(), strict=True):
        one = found.where((F.col("type") == kind) & F.col("in_range")).groupBy(*CHUNK).agg(F.collect_list(row).alias(name))
        out = out.join(one, CHUNK, "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    box = F.struct("frame", "detector", "det_idx", "class_name", "conf", "x1", "y1", "x2", "y2")
    # Chunks overlap, so that boxes outside the valid range come along too.
    seen = boxes.join(plan, "video_id").where("frame between context_start and context_end").groupBy(*CHUNK).agg(F.collect_list(box).alias("boxes"))
    return out.join(seen, CHUNK, "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(seen.schema["boxes"].dataType)))


def rows(df, *cols):
    return sorted(map(str, map(tuple, df.select(*cols).collect())))


@pytest.mark.parametrize("files", [1, 4])
def test_chunks_in_any_order_equal_whole_videos(spark, given, tmp_path, files):
    found, plan, size, boxes = given
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    all_messages = durable(messages(given)).withColumn("__n", F.pmod(F.xxhash64(*CHUNK), F.lit(files)))
    for n in range(files):
        all_messages.where(F.col("__n") == n).drop("__n").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(all_messages.drop("__n").schema).option("maxFilesPerTrigger", 1).parquet(source)
    params = coupled(TrackParams(), 0.5)
    query = (
        videos_stream(live, params).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    got = spark.read.parquet(out)

    owned = own.dedup_owned(cat.owned_transitions(found, plan))
    scenes = durable(own.build_scenes(owned, size))
    transition = ["video_id", "type", "start_frame", "end_frame"]
    assert rows(got.where("kind = 'transition'"), *transition) == rows(owned, *transition)
    scene = ["video_id", "scene_no", "start_frame", "end_frame"]
    assert rows(got.where("kind = 'scene'"), *scene) == rows(scenes, *scene)
    tracks = number_tracks(associate_tracks(durable(assign_scene(boxes, scenes)), params), size)
    box = ["video_id", "scene_no", "frame", "detector", "det_idx", "class_name", "track_id"]
    shown = got.where("kind = 'box'")
    assert rows(shown, *box) == rows(tracks, *box)
    assert shown.agg(F.max("track_id")).first()[0] > 3 and shown.select("scene_no").distinct().count() > 5
