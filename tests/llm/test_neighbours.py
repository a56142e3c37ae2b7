"""Nearest frames against a full scan."""

import numpy as np

from shotspark.llm.neighbours import VantageTree, nearest_frames

SCHEMA = "video_id string, frame bigint, feature array<double>, score string, rank string"


def rows(vectors, video="v"):
    return [(video, i, None if v is None else [None if x is None else float(x) for x in v], "s", "r") for i, v in enumerate(vectors)]


def brute(table, queries, k):
    table = {(v, f): x for v, f, x, *_ in table}
    ok = lambda x: x and all(c is not None and np.isfinite(c) for c in x) and any(x)
    out = []
    for v, f, x, *_ in dict.fromkeys((v, f, tuple(x) if x else None) for v, f, x, *_ in queries):
        if not ok(x):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y, strict=True)), *name)
            for name, y in table.items()
            if name != (v, f) and ok(y) and len(y) == len(x)
        )
        out += [(v, f, i + 1, *name, -s) for i, (s, *name) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, table, queries, **options):
    got = nearest_frames(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(queries, SCHEMA), **options)
    return sorted(tuple(r) for r in got.collect())


def test_ties_bad_rows_and_shards(spark):
    draw = np.random.default_rng(1)
    vectors = [*draw.integers(-2, 3, (60, 4)), None, [], [0, 0, 0, 0], [1, None, 0, 0], [float("nan"), 1, 0, 0],
               [float("inf"), 1, 0, 0], [1, 2], [2, 1], *([[1, 1, 1, 1]] * 9)]
    table = rows([list(v) if v is not None else None for v in vectors])
    asked = table[::5] + table[-2:]
    for shard_rows in (8, 1000):
        assert found(spark, table, asked, k=7, shard_rows=shard_rows) == brute(table, asked, 7)


def test_repeated_rows_count_once_and_few_candidates_are_enough(spark):
    table = rows([[1, 0], [2, 0]]) * 3
    assert found(spark, table, table, k=20) == [("v", 0, 1, "v", 1, 2.0), ("v", 1, 1, "v", 0, 2.0)]


def test_empty(spark):
    assert found(spark, [], [], k=3) == []
    assert found(spark, rows([[1, 0]]), [], k=3) == []


def test_relaxed_pruning_keeps_recall():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = VantageTree(x, [("v", i) for i in range(len(x))], 11)
    queries = x[:100]
    exact, best = tree.search(queries, 11, 1.0)
    assert np.allclose(best, -np.sort(-queries @ x.T, axis=1)[:, :11])
    near, _ = tree.search(queries, 11, 2.0)
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(exact, near, strict=True)]) > 0.9
