"""Scenes packed into windows of equal size by multiway differencing (Karmarkar and Karp)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.session import durable

#: Windows of one group are numbered below this; a group never has as many.
GROUP_SPAN = 1 << 32


def cut_points(length: int, window: int, grain: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a scene: whole windows, then grains, then the rest."""
    whole = length - length % window
    for start in range(0, whole, window):
        yield start, window
    for start in range(whole, length, grain):
        yield start, min(grain, length - start)


def differencing(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item and the load of each window.

    Every item starts as a partition of its own, with all other windows empty.  The two
    partitions with the largest spread are merged again and again, the fullest window of one
    with the emptiest of the other, so that their imbalances cancel.  Empty windows are not
    stored; a window is a chain of items, kept as a forest of merged labels.
    """
    n = len(lengths)
    parent = np.arange(n)
    heap = [(-int(size), i) for i, size in enumerate(lengths)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {
        i: (np.array([size]), np.array([i])) for i, size in enumerate(lengths)
    }
    fresh = n
    while len(heap) > 1:
        (loads_a, names_a), (loads_b, names_b) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        shared = len(loads_a) + len(loads_b) - windows
        if shared > 0:
            # Loads are descending: the last ``shared`` of a meet the last of b in opposite order.
            low_a, low_b = loads_a[-shared:], loads_b[-shared:][::-1]
            parent[names_b[-shared:][::-1]] = names_a[-shared:]
            loads = np.concatenate([loads_a[:-shared], low_a + low_b, loads_b[:-shared]])
            names = np.concatenate([names_a, names_b[:-shared]])
        else:
            loads, names = np.concatenate([loads_a, loads_b]), np.concatenate([names_a, names_b])
        order = np.argsort(-loads, kind="stable")
        loads, names = loads[order], names[order]
        parts[fresh] = loads, names
        spread = int(loads[0] - (loads[-1] if len(loads) == windows else 0))
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    loads, names = parts.popitem()[1]
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    number = np.empty(n, dtype=np.int64)
    number[names] = np.arange(len(names))
    return number[parent], loads


def near_equal(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each item; the window count rises until no window overflows."""
    total = int(lengths.sum())
    windows = max(1, math.ceil(total / window))
    while True:
        where, loads = differencing(lengths, windows)
        over = int(loads.max()) - window
        if over <= 0:
            break
        windows = max(windows + 1, math.ceil(total / max(1.0, total / windows - over / 2)))
        windows = min(windows, len(lengths))
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(lengths[order])
    firsts = np.flatnonzero(np.diff(where[order], prepend=-1))
    base = np.zeros(len(order), dtype=np.int64)
    base[firsts] = np.diff(ends[firsts] - lengths[order][firsts], prepend=0)
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = ends - lengths[order] - np.cumsum(base)
    return where, offset


def pack_scenes(
    scenes: DataFrame, window_frames: int = 2048, grain_frames: int = 512, group_pieces: int = 2048
) -> DataFrame:
    """Pack scenes into training windows of ``window_frames`` frames with little padding.

    ``scenes`` has ``video_id, scene_no, start_frame, end_frame`` (inclusive) and any further
    columns, which stay (``piece_start``, ``window_id`` and ``window_offset`` are replaced).
    A scene is cut into whole windows, then grains of ``grain_frames``, then the rest; every
    piece is one row with its own ``start_frame`` and ``end_frame``, ``piece_start`` (frames of
    the scene before it), ``window_id BIGINT`` and ``window_offset BIGINT``; the pieces of a
    window leave no gap from 0 on.  Scenes with a null or reversed range have no frames and
    give no rows; repeated rows are packed as often as they occur.

    Pieces are dealt by row number into groups of about ``group_pieces``, so no key can be
    hot; within a group multiway differencing gives near-equal windows.
    """
    length = F.col("end_frame") - F.col("start_frame") + 1
    whole = (length - length % window_frames).cast("long")
    starts = F.concat(
        F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(window_frames).cast("long")))
        .otherwise(F.array().cast("array<bigint>")),
        F.when(length > whole, F.sequence(whole, length.cast("long") - 1, F.lit(grain_frames).cast("long")))
        .otherwise(F.array().cast("array<bigint>")),
    )
    pieces = (
        scenes.drop("piece_start", "window_id", "window_offset", "piece_group")
        .filter(length > 0)
        .withColumn("piece_start", F.explode(starts))
    )
    size = F.when(F.col("piece_start") < whole, F.lit(window_frames)).otherwise(
        F.least(F.lit(grain_frames), length - F.col("piece_start"))
    )
    # Both ends are named from the scene's own range before it is replaced by the piece's.
    pieces = pieces.withColumns(
        {"start_frame": F.col("start_frame") + F.col("piece_start"),
         "end_frame": F.col("start_frame") + F.col("piece_start") + size - 1}
    )
    # Written before rows are numbered, so that a lost task numbers the same rows again.
    pieces = durable(pieces)
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn(
        "piece_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    )
    def pack(table: pa.Table) -> pa.Table:
        start, end = (table[c].to_numpy().astype(np.int64) for c in ("start_frame", "end_frame"))
        lengths = end - start + 1
        where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = lengths == window_frames
        count = 0
        if (~full).any():
            where[~full], offset[~full] = near_equal(lengths[~full], window_frames)
            count = int(where[~full].max()) + 1
        where[full] = count + np.arange(int(full.sum()))
        group = table["piece_group"][0].as_py()
        return table.drop_columns(["piece_group"]).append_column(
            "window_id", pa.array(group * GROUP_SPAN + where)
        ).append_column("window_offset", pa.array(offset))

    placed = (T.StructField("window_id", T.LongType()), T.StructField("window_offset", T.LongType()))
    schema = T.StructType([*pieces.schema.fields, *placed])
    return dealt.groupBy("piece_group").applyInArrow(pack, schema)
