"""Nearest frames by inner product: one vantage-point tree per shard of frame features.

Largest inner product is nearest Euclidean neighbour once every feature gets one more
component, ``sqrt(M^2 - |x|^2)`` with ``M`` the shard's largest norm, and every query a zero
there.  In that space the triangle inequality holds, so a tree may skip a side whose ball
lies further away than the k-th neighbour found so far.  ``factor`` multiplies that lower
bound: 1 prunes only what cannot matter (exact search), more prunes earlier.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotspark.session import durable

INDEX = "dim int, shard int, tree binary"
FOUND = "video_id string, frame bigint, match_video_id string, match_frame bigint, score double"


def usable(feature: Column) -> Column:
    """Features that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(
        feature, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(feature, lambda x: x != 0), F.lit(False))


def _taking_part(frames: DataFrame) -> DataFrame:
    return (
        frames.select("video_id", "frame", F.col("feature").cast("array<double>").alias("feature"))
        .filter(F.col("video_id").isNotNull() & F.col("frame").isNotNull() & usable(F.col("feature")))
        .withColumn("dim", F.size("feature"))
    )


class VantageTree:
    """A vantage-point tree over the distinct features of one shard.

    ``names`` lists, for each distinct feature, the smallest ``keep`` (video_id, frame) that
    carry it; features are numbered by their smallest name, so ties resolve by number.
    """

    def __init__(self, features: np.ndarray, names: list, keep: int, leaf: int = 128):
        order = sorted(range(len(names)), key=names.__getitem__)
        members: dict[bytes, list] = {}
        rows = []
        features = features + 0.0  # -0.0 and 0.0 are one value
        for i in order:
            own = members.setdefault(features[i].tobytes(), [])
            if not own:
                rows.append(i)
            if len(own) < keep and (not own or own[-1] != names[i]):
                own.append(names[i])
        self.x = features[rows]
        self.names = list(members.values())
        norms = np.einsum("ij,ij->i", self.x, self.x)
        self.m2 = float(norms.max())
        self.lift = np.sqrt(np.maximum(self.m2 - norms, 0.0))
        self.nodes: list = []
        self.root = self._build(np.arange(len(rows)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        if len(rows) <= leaf:
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        x = np.column_stack([self.x[rows], self.lift[rows]])
        away = np.linalg.norm(x - x.mean(axis=0), axis=1)
        at = int(away.argmax())
        d = np.linalg.norm(x - x[at], axis=1)
        near = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = near[:half], near[half:]
        bounds = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        sides = self._build(rows[inner], leaf), self._build(rows[outer], leaf)
        self.nodes.append((int(rows[at]), bounds, sides))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the ``k`` best distinct features of each query."""
        n = len(queries)
        best = np.full((n, k), -np.inf)
        which = np.full((n, k), len(self.x), dtype=np.int64)
        own2 = np.einsum("ij,ij->i", queries, queries) + self.m2

        def reach(active: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                left = own2[active] - 2 * best[active, -1]
            return np.sqrt(np.maximum(left, 0.0)) * (1 + 1e-9) + 1e-9

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            parts = self.nodes[node]
            if len(parts) == 1:
                rows = parts[0]
                got = queries[active] @ self.x[rows].T
                better = (got >= best[active, -1][:, None]).any(axis=1)
                some = active[better]
                if not len(some):
                    return
                score = np.concatenate([best[some], got[better]], axis=1)
                number = np.concatenate([which[some], np.broadcast_to(rows, (len(some), len(rows)))], axis=1)
                first = np.lexsort((number, -score), axis=1)[:, :k]
                best[some] = np.take_along_axis(score, first, axis=1)
                which[some] = np.take_along_axis(number, first, axis=1)
                return
            at, (in_lo, in_hi, out_lo, out_hi), (inner, outer) = parts
            d = np.sqrt(np.maximum(own2[active] - 2 * (queries[active] @ self.x[at]), 0.0))
            bound_in = factor * np.maximum(np.maximum(in_lo - d, d - in_hi), 0.0)
            bound_out = factor * np.maximum(np.maximum(out_lo - d, d - out_hi), 0.0)
            inside = d <= (in_hi + out_lo) / 2
            for first in (True, False):
                into_inner = inside if first else ~inside
                keep = into_inner & (bound_in <= reach(active))
                visit(inner, active[keep])
                keep = ~into_inner & (bound_out <= reach(active))
                visit(outer, active[keep])

        visit(self.root, np.arange(n))
        return which, best


def build_index(frames: DataFrame, keep: int, shard_rows: int = 8192) -> DataFrame:
    """One pickled :class:`VantageTree` per shard of about ``shard_rows`` frames, written once."""
    frames = _taking_part(frames)
    shards = max(1, math.ceil(frames.count() / shard_rows))
    placed = frames.withColumn(
        "shard", F.pmod(F.xxhash64("video_id", "frame", "feature"), F.lit(shards)).cast("int")
    )

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        names = list(zip(table["video_id"].to_pylist(), table["frame"].to_pylist(), strict=True))
        flat = table["feature"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tree = VantageTree(flat.reshape(len(names), -1).astype(np.float64), names, keep)
        own = {"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(own | {"tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    return durable(placed.groupBy("dim", "shard").applyInArrow(grow, INDEX))


def search_index(index: DataFrame, queries: DataFrame, k: int, factor: float, block_rows: int = 4096) -> DataFrame:
    """The best ``k`` frames of every shard for every query; each (shard, query block) is one group."""
    queries = _taking_part(queries).distinct().withColumn("feature_key", F.xxhash64("video_id", "frame", "feature"))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = (
        queries.withColumn("block", F.pmod("feature_key", F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .select("dim", "shard", "block", "video_id", "frame", "feature")
    )
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and asked.num_rows:
            tree = pickle.loads(trees["tree"][0].as_py())
            names = list(zip(asked["video_id"].to_pylist(), asked["frame"].to_pylist(), strict=True))
            flat = asked["feature"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(len(names), -1).astype(np.float64)
            which, _ = tree.search(vectors, k + 1, factor)
            for name, vector, numbers in zip(names, vectors, which, strict=True):
                numbers = numbers[numbers < len(tree.x)]
                scores = (tree.x[numbers] * vector).sum(axis=1)
                found = [
                    (-s, other)
                    for s, i in zip(scores.tolist(), numbers.tolist(), strict=True)
                    for other in tree.names[i]
                    if other != name
                ]
                out += [(*name, *other, -s) for s, other in sorted(found)[:k]]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64())
        titles = ("video_id", "frame", "match_video_id", "match_frame", "score")
        return pa.table({t: pa.array(c, kind) for t, c, kind in zip(titles, columns, kinds, strict=True)})

    key = ("dim", "shard", "block")
    return trees.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(look, FOUND)


def nearest_frames(
    frames: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8192
) -> DataFrame:
    """The ``k`` frames with the largest inner product for every query frame.

    ``frames`` and ``queries`` have ``video_id STRING, frame BIGINT, feature ARRAY<FLOAT or
    DOUBLE>``; further columns are ignored.  Features that are null, empty, all zero or hold a
    null or non-finite component take no part, nor do rows without a name; features of
    different lengths never meet.  A frame is not its own neighbour; rows that repeat a
    frame's name with the same feature count once, and ties go to the smaller
    ``(match_video_id, match_frame)``.  No rows in, no rows out.

    Result: ``video_id, frame, rank INT`` (from 1), ``match_video_id, match_frame, score
    DOUBLE`` (the inner product of the original features).  ``factor`` 1 searches exactly;
    larger values relax the pruning.  Every shard meets every block of queries, and neither
    grows with the input.
    """
    found = search_index(build_index(frames, k + 1, shard_rows), queries, k, factor)
    best = Window.partitionBy("video_id", "frame").orderBy(F.desc("score"), "match_video_id", "match_frame")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("video_id", "frame", "rank", "match_video_id", "match_frame", "score")
    )
