"""Fusion and tracking: literal vectors, and large-group paths against the simple ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.tracking import box_scenes
from shotspark.operators import fusion, tracking
from shotspark.plans.tracks import coupled, raw_tracks, track_videos
from shotspark.session import durable

SCHEMA = "video_id BIGINT, frame BIGINT, detector INT, det_idx BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conf DOUBLE, class_name STRING"

# Literal inputs below have outcomes that the rules prescribe.


def scene(spark, last=10_000_000):
    return spark.createDataFrame([(1, 0, 0, last)], "video_id BIGINT, scene_no BIGINT, start_frame BIGINT, end_frame BIGINT")


def size(spark):
    return spark.createDataFrame([(1, 1280, 720)], "video_id BIGINT, width INT, height INT")


def sizes(dets):
    return dets.select("video_id").distinct().withColumns({"width": F.lit(1280), "height": F.lit(720)})


def test_two_detectors_give_one_track(spark):
    dets = spark.createDataFrame(
        [(1, 7, 0, 0, 0.0, 0.0, 6.0, 6.0, 0.80, "tank"), (1, 7, 1, 0, 0.2, 0.2, 6.2, 6.2, 0.90, "tank")], SCHEMA
    )
    got = track_videos(dets, scene(spark), size(spark)).collect()
    assert [(r.frame, r.track_id, r.confidence) for r in got] == [(7, 0, 0.90)]


def test_weak_boxes_are_not_emitted_and_take_no_number(spark):
    dets = spark.createDataFrame(
        [(1, 7, 0, 0, 0.0, 0.0, 5.0, 5.0, 0.20, "car"), (1, 7, 0, 1, 20.0, 20.0, 25.0, 25.0, 0.80, "car")], SCHEMA
    )
    got = track_videos(dets, scene(spark), size(spark)).collect()
    assert [(r.frame, r.track_id, r.confidence) for r in got] == [(7, 0, 0.80)]


def test_nms_rounds_equal_the_fold(spark, sf):
    """Boxes crowded into few frames, decided three at a time."""
    dets = durable(fx.detections(spark, sf).withColumn("det_idx", F.col("frame") * 100 + F.col("det_idx")).withColumn("frame", F.expr("frame div 40")))
    whole = fusion.class_nms(dets, group_limit=1_000_000)
    rounds = fusion.class_nms(dets, group_limit=9)
    assert 0 < whole.count() < dets.count()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rounds.collect()))


def test_nms_leaves_no_overlap(spark, sf):
    from shotspark.functions.boxes import iou

    kept = fusion.class_nms(fx.detections(spark, sf)).withColumn("b", F.struct("x1", "y1", "x2", "y2"))
    a = kept.select("video_id", "frame", "class_name", "det_idx", F.col("b").alias("p"))
    b = kept.select("video_id", "frame", "class_name", F.col("det_idx").alias("other"), F.col("b").alias("q"))
    pairs = a.join(b, ["video_id", "frame", "class_name"]).where("det_idx < other")
    assert pairs.count() > 0 and pairs.where(iou(F.col("p"), F.col("q")) >= 0.55).count() == 0


def test_assignment_is_optimal():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(rnd.integers(1, 5)), int(rnd.integers(1, 6))
        cost, limit = rnd.random((n, m)).round(2), 0.6
        pairs = tracking._assign(cost, limit)
        assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
        assert all(cost[a, b] <= limit for a, b in pairs)
        best = min(
            sum(min(cost[i, j] - limit, 0.0) for i, j in zip(rows, cols))
            for k in [min(n, m)]
            for rows in itertools.permutations(range(n), k)
            for cols in itertools.combinations(range(m), k)
        )
        assert abs(sum(cost[a, b] - limit for a, b in pairs) - best) < 1e-9


def walk(spark, frames, seed=5, objects=5):
    """Boxes of objects that wander, vanish and return; some frames are empty."""
    rnd = random.Random(seed)
    at = [(rnd.uniform(0, 60), rnd.uniform(0, 60)) for _ in range(objects)]
    rows = []
    for f in range(frames):
        for i, (x, y) in enumerate(at):
            at[i] = (x + rnd.uniform(-2, 2), y + rnd.uniform(-2, 2))
            if rnd.random() < 0.7 and not 300 < f < 330 and not 500 < f < 560:
                rows.append((1, f, 0, i, x, y, x + 20, y + 20, round(rnd.uniform(0.05, 1), 3), "car"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("piece", [113])
def test_pieces_equal_one_sequential_run(spark, piece):
    """The same tracks come out however a long scene is cut into pieces."""
    dets = durable(tracking.assign_scene(walk(spark, 800), scene(spark)))

    def groups(df):
        tracks = {}
        for r in df.collect():
            tracks.setdefault((r.segment, r.raw_id), []).append((r.frame, r.det_idx))
        return sorted(tuple(sorted(t)) for t in tracks.values())

    whole = groups(tracking.associate_tracks(dets, piece_frames=100_000))
    cut = groups(tracking.associate_tracks(dets, piece_frames=piece))
    assert any(t[-1][0] - t[0][0] > 2 * piece for t in whole)
    assert whole == cut


def test_rounds_do_not_grow_with_pieces(spark, monkeypatch):
    """Two objects that never leave, born in one order and ranked by the detector in the other."""

    def tables(frames):
        rows = [(1, 0, 0, 0, 0.0, 0.0, 20.0, 20.0, 0.9, "car")]
        for f in range(1, frames):
            rows += [(1, f, 0, 1, 0.0, 0.0, 20.0, 20.0, 0.9, "car"), (1, f, 0, 0, 50.0, 0.0, 70.0, 20.0, 0.9, "car")]
        dets = durable(tracking.assign_scene(spark.createDataFrame(rows, SCHEMA), scene(spark)))
        written = []
        monkeypatch.setattr(tracking, "durable", lambda df: written.append(1) or durable(df))
        tracks = tracking.associate_tracks(dets, piece_frames=60).groupBy("raw_id").count().collect()
        assert sorted(r["count"] for r in tracks) == [frames - 1, frames]
        return len(written)

    few, many = tables(4 * 60), tables(16 * 60)
    # Only following tracks back to their birth, which doubles its reach, may add a table or two.
    assert many - few <= 2


def test_weak_threshold_follows_emission(spark):
    """With a higher emission threshold nothing below it starts a track."""
    dets = spark.createDataFrame(
        [(1, f, 0, 0, 0.0, 0.0, 20.0, 20.0, c, "car") for f, c in ((1, 0.6), (2, 0.6), (3, 0.8), (4, 0.6))], SCHEMA
    )
    got = raw_tracks(dets, scene(spark), coupled(tracking.TrackParams(), 0.7)).collect()
    assert sorted(r.frame for r in got) == [3, 4]


def test_segments_split_at_long_gaps(spark):
    dets = tracking.assign_scene(walk(spark, 800), scene(spark))
    starts = sorted(r.segment for r in tracking.track_segments(dets, block=64).collect())
    assert len(starts) == 2 and starts[0] < 3 and 555 < starts[1] < 570


def test_track_numbers_are_dense_and_follow_first_emission(spark, sf):
    dets = fx.detections(spark, sf)
    rows = track_videos(dets, box_scenes(spark, sf), sizes(dets)).collect()
    first = {}
    for r in rows:
        k = (r.video_id, r.scene_no)
        at = (r.frame, r.detector, r.det_idx)
        first.setdefault(k, {}).setdefault(r.track_id, []).append(at)
    for tracks in first.values():
        assert sorted(tracks) == list(range(len(tracks)))
        starts = [min(tracks[i]) for i in range(len(tracks))]
        assert starts == sorted(starts)
        assert all(len({f for f, *_ in t}) == len(t) for t in tracks.values())


def test_resets(spark):
    """A cut at frame 1 resets inside one scene name; the first interval always starts anew."""
    scenes = spark.createDataFrame([(1, 0, 5, 0, 1), (1, 0, 5, 2, 3)], "video_id BIGINT, chunk_index BIGINT, scene_no BIGINT, start_frame BIGINT, end_frame BIGINT")
    cuts = spark.createDataFrame([(1, 0, 1)], "video_id BIGINT, chunk_index BIGINT, end_frame BIGINT")
    got = {r.start_frame: (r.after_cut, r.scene_changed) for r in tracking.tracker_resets(scenes, cuts).collect()}
    assert got == {0: (False, True), 2: (True, False)}
