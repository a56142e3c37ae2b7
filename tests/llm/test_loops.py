"""Loops: Lyndon arrays, exact filter and runs against plain definitions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotspark.llm.loops import find_loops, lyndon_array, repeating_stretches, runs_of


def plain_runs(w, shortest):
    """Every maximal repetition by definition: all periods, longest stretches, smallest period."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(2 * q, shortest):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, m, q) for (s, m), q in best.items())


def plain_lyndon(w):
    """A word is Lyndon if it is smaller than all its proper suffixes."""
    n = len(w)
    lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
    return [max(k for k in range(1, n - i + 1) if lyndon(w[i : i + k])) for i in range(n)]


WORDS = st.one_of(
    st.lists(st.integers(0, 2), max_size=40),
    st.builds(lambda a, u, k, b: a + u * k + b, *[st.lists(st.integers(0, 3), max_size=8)] * 2, st.integers(0, 6), st.lists(st.integers(0, 3), max_size=6)),
)


@settings(max_examples=400, deadline=None)
@given(WORDS)
def test_lyndon_arrays_of_both_orders(w):
    assert lyndon_array(w) == plain_lyndon(w)
    assert lyndon_array([-x for x in w]) == plain_lyndon([-x for x in w])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_of_several_sequences(words, shortest):
    got = runs_of([np.array(w, np.int64) for w in words], shortest)
    assert [list(map(tuple, r.tolist())) for r in got] == [plain_runs(w, shortest) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4))
def test_no_run_lies_outside_the_ranges(words):
    codes = np.array([x for w in words for x in w], np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    ranges = repeating_stretches(codes, owner).tolist()
    base = 0
    for w in words:
        for s, m, _ in plain_runs(w, 12):
            assert any(b <= base + s and base + s + m <= e for b, e in ranges)
        base += len(w)
    assert all(owner[b] == owner[e - 1] for b, e in ranges)
    assert all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))


def plain_once(w, runs):
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [x for i, x in enumerate(w) if i not in drop]


def test_videos_of_labels(spark):
    draw = random.Random(3)
    rows = [(1, None), (None, []), (2, ["car"] * 30), (2, ["car"] * 30), (3, [None, "a", None, "b"] * 5), (4, ["x"] * 11)]
    for i in range(40):
        unit = [draw.choice("abc") for _ in range(draw.randrange(1, 9))]
        rows.append((i, [draw.choice("abcdefgh") for _ in range(draw.randrange(30))] + unit * draw.randrange(8) + ["z", "a"]))
    videos = spark.createDataFrame([(k, v, 7) for k, v in rows], "video_id int, labels array<string>, loops int")
    got = find_loops(videos.repartition(3)).collect()
    want = []
    for k, v in rows:
        runs = plain_runs(v or [], 12)
        want.append((k, len(v or []), runs, plain_once(v or [], runs)))
    assert sorted(str((r.video_id, r.n_frames, [tuple(x) for x in r.loops], r.once)) for r in got) == sorted(map(str, want))
    assert find_loops(videos.limit(0)).count() == 0


def test_texts_and_very_long_rows(spark):
    rows = [("a", None), ("b", ""), ("c", " \t\n"), ("d", "car bus  car\nbus " * 9), ("e", "w " * 200_000), ("f", " ".join(map(str, range(150_000))))]
    got = {r.video_id: r for r in find_loops(spark.createDataFrame(rows, "video_id string, labels string")).collect()}
    assert [(got[k].n_frames, got[k].loops, got[k].once) for k in "abc"] == [(0, [], "")] * 3
    assert [tuple(x) for x in got["d"].loops] == [(0, 27, 3)] and got["d"].once == "car bus car bus"
    assert [tuple(x) for x in got["e"].loops] == [(0, 200_000, 1)] and got["e"].once == "w"
    assert got["f"].loops == [] and got["f"].once == rows[-1][1]
