"""Packing: every frame once, no window too full, little padding; token ids as the tokenizer gives them."""

import array
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shotspark.llm.packing import cut_points, differencing, near_equal, pack_scenes
from shotspark.llm.tokens import scenes_of_texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_pairs_opposing_imbalances():
    where, loads = differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(loads) == [14, 16]  # the classic example of the heuristic
    assert sorted(np.bincount(where, [8, 7, 6, 5, 4])) == [14, 16]


def test_near_equal_windows():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 513, 1500)
    where, offset = near_equal(lengths, 2048)
    loads = np.bincount(where, lengths)
    assert loads.max() <= 2048 and lengths.sum() > 0.985 * 2048 * len(loads)
    for w in range(len(loads)):
        own = np.flatnonzero(where == w)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()


def test_window_count_rises_when_capacity_is_exceeded():
    where, _ = near_equal(np.array([6, 6, 6]), 10)
    assert len(set(where.tolist())) == 3


def test_pack_scenes(spark):
    scenes = [("a", 0, 0, 4999, 1), ("b", 0, 10, 10, 2), ("b", 1, 100, 611, 3), ("c", 0, 5, 4, 4), (None, None, None, None, 5),
              ("b", 0, 10, 10, 2)]
    df = spark.createDataFrame(scenes, "video_id string, scene_no int, start_frame bigint, end_frame bigint, window_id int")
    got = pack_scenes(df, 2048, 512).collect()
    frames = sorted((r.video_id, f) for r in got for f in range(r.start_frame, r.end_frame + 1))
    want = sorted((v, f) for v, _, a, b, _ in scenes if v for f in range(a, b + 1))
    assert frames == want
    windows = {}
    for r in got:
        windows.setdefault(r.window_id, []).append((r.window_offset, r.end_frame - r.start_frame + 1))
        assert r.start_frame - r.piece_start in (0, 10, 100)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_scenes(df.limit(0)).count() == 0


def test_token_scenes(spark):
    texts = ["", None, "It's   the 3rd TEST, isn't it?!", "Été naïve é ÅNGSTRÖM ΣΊΣΥΦΟΣ 漢字かな 🙂🙂", "a\x1fb c d", "x" * 300,
             "ends. with... signs### $$$ l'été", "Wörter und Sätze, " * 700]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "key bigint, text string, video_id string")
    got = {}
    for r in scenes_of_texts(df, VOCABULARY, 1, window=64, grain=16).collect():
        got.setdefault(r.key, []).append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(got[i], key=lambda r: r.start_frame)
        assert [(r.start_frame, r.end_frame - r.start_frame + 1) for r in pieces] == list(cut_points(len(ids), 64, 16))
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array.array("I", ids[r.start_frame : r.end_frame + 1]).tobytes())
