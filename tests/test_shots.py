"""Literal vectors for detection, chunking, ownership and scenes, and their properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.operators import chunks, detect, ownership
from shotspark.plans.shots import detected
from shotspark.session import durable
from shotspark.streaming.folds import ChunkRanges, Pending, own_gradual_step

# Literal inputs below have outcomes that the rules prescribe.


def scores(spark, boundary, transition):
    rows = [(1, i, b, t) for i, (b, t) in enumerate(zip(boundary, transition))]
    return spark.createDataFrame(rows, "video_id BIGINT, frame BIGINT, boundary_p DOUBLE, transition_p DOUBLE")


@pytest.mark.parametrize("block", [3, 65_536])
def test_gradual_with_inner_peak_and_a_cut(spark, block):
    s = scores(
        spark,
        [0.1, 0.1, 0.6, 0.9, 0.7, 0.2, 0.1, 0.1, 0.2, 0.85, 0.1],
        [0.1, 0.1, 0.7, 0.8, 0.75, 0.65, 0.1, 0.1, 0.1, 0.8, 0.1],
    )
    p = detect.DetectParams(0.55, 0.55, 0.6, 3, 1, block)
    got = sorted((r.type, r.start_frame, r.end_frame, round(r.confidence, 9)) for r in detect.detect_transitions(s, p).collect())
    assert got == [("gradual_transition", 2, 5, round(math.sqrt(0.8 * 0.9), 9)), ("hard_cut", 9, 9, 0.85)]


def test_unconfirmed_gradual(spark):
    s = scores(
        spark,
        [0.1, 0.1, 0.2, 0.3, 0.4, 0.3, 0.2, 0.1, 0.1, 0.1],
        [0.1, 0.1, 0.9, 0.88, 0.91, 0.9, 0.87, 0.89, 0.1, 0.1],
    )
    assert detect.detect_transitions(s).count() == 0


def test_detection_does_not_depend_on_the_block_width(spark, sf):
    s = fx.frame_scores(spark, sf)
    wide, narrow = detect.detect_transitions(s), detect.detect_transitions(s, detect.DetectParams(block=5))
    assert wide.count() > 0
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))


def test_chunk_plans(spark):
    v = spark.createDataFrame(
        [(1, 10, 640, 360), (2, 511, 2560, 1440), (3, 302, 1280, 720)], "video_id BIGINT, frame_count BIGINT, width INT, height INT"
    )
    small = chunks.plan_chunks(chunks.effective_chunking(v.where("video_id = 1"), 4, 2, None))
    got = sorted((r.context_start, r.context_end, r.valid_start, r.valid_end) for r in small.collect())
    assert got == [(0, 3, 0, 3), (2, 7, 4, 7), (6, 9, 8, 9)]
    bounded = chunks.effective_chunking(v)
    assert {r.video_id: r.chunk_size for r in bounded.collect()} == {1: 64, 2: 6, 3: 23}
    counts = chunks.plan_chunks(bounded).groupBy("video_id").count().collect()
    assert {r.video_id: r["count"] for r in counts} == {1: 1, 2: 86, 3: 14}


def test_memory_bound(spark):
    v = spark.createDataFrame([(1, 30, 100, 100)], "video_id BIGINT, frame_count BIGINT, width INT, height INT")
    got = chunks.effective_chunking(v, 64, 16, 100 * 100 * 3 * 10)
    assert tuple(got.select("chunk_size", "overlap").first()) == (8, 2)
    assert sorted(r.valid_start for r in chunks.plan_chunks(got).collect()) == [0, 8, 16, 24]
    assert chunks.effective_chunking(v, 64, 16, 29_999).first().chunk_size is None


CHUNKS = [(1, 0, 0, 63, 0, 63, False), (1, 1, 48, 127, 64, 127, False), (1, 2, 112, 191, 128, 191, True)]
CHUNK_SCHEMA = "video_id BIGINT, chunk_index BIGINT, context_start BIGINT, context_end BIGINT, valid_start BIGINT, valid_end BIGINT, is_last BOOLEAN"
DET_SCHEMA = "video_id BIGINT, chunk_index BIGINT, type STRING, local_start BIGINT, local_end BIGINT, confidence DOUBLE"


def owned(spark, dets):
    plan = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA)
    g = durable(ownership.globalise(spark.createDataFrame([(1, *d) for d in dets], DET_SCHEMA), plan))
    gradual = ownership.own_gradual(g, plan)
    hard = ownership.suppress_owned(ownership.own_hard(g), gradual)
    return (
        sorted((r.chunk_index, r.start_frame, r.end_frame, r.confidence) for r in gradual.collect()),
        sorted((r.chunk_index, r.end_frame, r.confidence) for r in hard.collect()),
        g, plan,
    )


def test_cut_belongs_to_one_chunk(spark):
    gradual, hard, *_ = owned(spark, [(1, "hard_cut", 2, 2, 0.7), (1, "hard_cut", 20, 20, 0.9)])
    assert gradual == [] and hard == [(1, 68, 0.9)]


def test_cut_inside_gradual(spark):
    gradual, hard, *_ = owned(spark, [(1, "gradual_transition", 12, 20, 0.88), (1, "hard_cut", 18, 18, 0.99)])
    assert gradual == [(1, 60, 68, 0.88)] and hard == []


def test_deferred_gradual(spark):
    gradual, _, g, plan = owned(spark, [(0, "gradual_transition", 50, 63, 0.81), (1, "gradual_transition", 2, 32, 0.9)])
    assert gradual == [(1, 50, 80, 0.9)]
    state = {r.chunk_index: (r.pending_start, r.pending_conf) for r in ownership.pending_after(g, plan).collect()}
    assert state == {0: (50, 0.81), 1: (None, None), 2: (None, None)}


def test_deferred_gradual_that_ends_at_the_border(spark):
    gradual, *_ = owned(spark, [(0, "gradual_transition", 50, 63, 0.81), (1, "gradual_transition", 2, 15, 0.86)])
    assert gradual == [(1, 50, 63, 0.86)]


def test_deferred_gradual_without_a_successor(spark):
    gradual, *_ = owned(spark, [(0, "gradual_transition", 50, 63, 0.81)])
    assert gradual == [(1, 50, 63, 0.81)]


def test_ownership_against_a_chunk_by_chunk_fold(spark):
    """Random chunk reports, long chains included, against the one-step-per-chunk rule."""
    rnd = random.Random(3)
    plan, dets, want = [], [], []
    for video in range(40):
        n, size, overlap = rnd.randint(1, 9), 6, 2
        state = Pending()
        for i in range(n):
            first, last = i * size, i * size + size - 1
            context = max(0, first - overlap)
            plan.append((video, i, context, last, first, last, i == n - 1))
            seen = set()
            for _ in range(rnd.randint(0, 3)):
                a = rnd.randint(context, last)
                b = rnd.choice([last, rnd.randint(a, last)])
                a = rnd.choice([a, context])
                if (a, b) not in seen:
                    seen.add((a, b))
                    dets.append((video, i, "gradual_transition", a - context, b - context, round(rnd.random(), 3)))
            mine = [(d[3] + context, d[4] + context, d[5]) for d in dets if d[:2] == (video, i)]
            want += [(video, i, *g) for g in own_gradual_step(state, ChunkRanges(last, first, last, i == n - 1, mine))]
    plan = spark.createDataFrame(plan, CHUNK_SCHEMA)
    g = durable(ownership.globalise(spark.createDataFrame(dets, DET_SCHEMA), plan))
    for block in (2, 65_536):
        got = ownership.own_gradual(g, plan, block=block)
        assert sorted(map(tuple, got.select("video_id", "chunk_index", "start_frame", "end_frame", "confidence").collect())) == sorted(want)


@pytest.mark.parametrize("block", [4, 65_536])
def test_scenes_tile_every_video(spark, sf, block):
    v = fx.videos(spark, sf)
    scenes = ownership.build_scenes(detected(fx.frame_scores(spark, sf)), v, block=block)
    ranges = {}
    for r in scenes.collect():
        ranges.setdefault(r.video_id, []).append((r.start_frame, r.end_frame, r.scene_no))
    counts = {r.video_id: r.frame_count for r in v.collect()}
    assert ranges.keys() == counts.keys()
    for video, parts in ranges.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == counts[video] - 1
        assert all(a[1] + 1 == b[0] and a[2] < b[2] for a, b in zip(parts, parts[1:]))


def test_scenes_after_equal_ends(spark):
    """Two transitions that end together skip one scene number."""
    t = spark.createDataFrame(
        [(1, "hard_cut", 9, 9), (1, "gradual_transition", 5, 9)], "video_id BIGINT, type STRING, start_frame BIGINT, end_frame BIGINT"
    )
    v = spark.createDataFrame([(1, 20)], "video_id BIGINT, frame_count BIGINT")
    got = sorted((r.scene_no, r.start_frame, r.end_frame) for r in ownership.build_scenes(t, v).collect())
    assert got == [(0, 0, 9), (2, 10, 19)]


def test_out_of_order_chunk(spark):
    c = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "video_id BIGINT, position BIGINT, chunk_index BIGINT")
    got = {r.position: (r.expected, r.in_order) for r in ownership.require_in_order(c).collect()}
    assert got == {0: (0, True), 1: (1, False)}


def test_windows_cover_the_video_and_pad(spark):
    v = spark.createDataFrame([(1, 100), (2, 101), (3, 250)], "video_id BIGINT, frame_count BIGINT")
    got = sorted((r.video_id, r.start_frame, r.end_frame) for r in chunks.plan_model_windows(v).collect())
    assert got == [(1, 0, 99), (2, 0, 99), (2, 80, 100), (3, 0, 99), (3, 80, 179), (3, 160, 249)]


@pytest.mark.parametrize("strip,per_call", [(1, 1), (2, 3), (32, 8)])
def test_score_hook_pads_and_averages(spark, strip, per_call):
    import pandas as pd

    lengths = {1: 25, 2: 10, 3: 3, 4: 300, None: 11}
    rows = [(v, i, float(i)) for v, n in lengths.items() for i in range(n + 4) if (v, i % 50) != (4, 7)]
    frames = spark.createDataFrame([*rows, (9, 0, 0.0)], "video_id BIGINT, frame BIGINT, v DOUBLE")
    counts = spark.createDataFrame([*lengths.items(), (5, 0), (6, 40)], "video_id BIGINT, frame_count BIGINT")

    def load():
        def model(pdf):
            assert len(pdf) % 10 == 0 and len(pdf) <= 10 * per_call and list(pdf.columns) == ["video_id", "frame", "v"]
            return pd.DataFrame({"boundary_p": pdf["v"] / 100, "transition_p": pdf["v"].to_numpy().reshape(-1, 10).max(axis=1).repeat(10)})

        return model

    raw = detect.score_frames(frames, load, counts, window=10, overlap=4, windows_per_call=per_call, strip=strip)
    want = []
    for video, n in lengths.items():
        start = number = 0
        while True:
            own = [f for v, f, _ in rows if v == video and start <= f < min(n, start + 10)]
            want += [(video, number, f, f / 100, float(max(own))) for f in own]
            if start + 10 >= n:
                break
            start, number = start + 6, number + 1
    assert sorted(map(str, map(tuple, raw.collect()))) == sorted(map(str, want))
    got = {(r.video_id, r.frame): (r.boundary_p, r.transition_p) for r in detect.average_window_scores(raw).collect()}
    assert got[1, 7] == (0.07, (9 + 15) / 2) and got[1, 24] == (0.24, 24.0)


def test_frames_travel_once_when_scored(spark):
    """One exchange, and next to no copies: the plan moves frames by strip alone."""
    frames = spark.range(20_000).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame"))
    counts = spark.createDataFrame([(1, 20_000)], "video_id BIGINT, frame_count BIGINT")
    scored = detect.score_frames(frames, lambda: lambda pdf: pdf.assign(boundary_p=0.0, transition_p=0.0), counts)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(pdf):
            calls.add(1)
            return pdf.assign(boundary_p=0.0, transition_p=0.0)

        return model

    assert detect.score_frames(frames, load, counts).count() == 20_000 + 249 * 20
    assert calls.value <= 250 / 8 + 20


def test_similarity_over_sparse_frames(spark):
    """Blocks without frames of their own, missing neighbours, and a brute-force comparison."""
    import numpy as np

    rnd = np.random.default_rng(2)
    frames = [0, 1, 2, 9, 10, 14, 29, 30]
    vectors = {f: rnd.random(6) for f in frames}
    df = spark.createDataFrame([(1, f, v.tolist()) for f, v in vectors.items()], "video_id BIGINT, frame BIGINT, embedding ARRAY<DOUBLE>")
    got = {r.frame: r.similarity for r in detect.banded_similarity(df, 7, block=4).collect()}
    assert sorted(got) == frames
    unit = {f: v / np.linalg.norm(v) for f, v in vectors.items()}
    for f in frames:
        want = [float(unit[f] @ unit[f + k]) if f + k in unit else 0.0 for k in range(-3, 4)]
        assert np.allclose(got[f], want)
    with pytest.raises(ValueError):
        detect.banded_similarity(df, 6)
