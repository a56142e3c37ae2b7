"""Loops in label sequences: all maximal periodic runs, by Lyndon roots of both orders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.texts import small_batches

#: Shortest run that is reported.
SHORTEST = 12
#: Odd multipliers of the window hash.
RANDOM = np.random.default_rng(13).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- where runs can lie


def repeating_stretches(codes: np.ndarray, owner: np.ndarray, shortest: int = SHORTEST, rounds: int = 20) -> np.ndarray:
    """``[begin, end)`` ranges, each of one owner, outside which no run of ``shortest`` or more lies.

    Windows have ``half = shortest // 2`` places.  A run of period q and length
    n >= max(shortest, 2 q) has its first m = n - q - half + 1 windows again within q places, and
    q < m + half.  So places whose window comes again lie in a stretch, and those where that is
    further away than the stretch allows can be dropped, round after round; a stretch
    of m places and the m + 2 half - 1 after it hold every run that begins there.  ``owner`` ascends.
    """
    half = shortest // 2
    n = len(codes) - half + 1
    if n < 1:
        return np.zeros((0, 2), np.int64)
    # Equal windows have equal hashes; unequal ones that share a hash only open a place too many.
    hashed = owner[:n].astype(np.uint64) * RANDOM[half]
    for k in range(half):
        hashed += codes[k : n + k].astype(np.uint64) * RANDOM[k]
    order = np.argsort(hashed, kind="stable")
    away = np.full(n, np.iinfo(np.int64).max)
    same = hashed[order[1:]] == hashed[order[:-1]]
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # Windows that cross into the next owner are closed, so no stretch does.
    is_open = (owner[:n] == owner[half - 1 :]) & (away < np.iinfo(np.int64).max)
    for _ in range(rounds):
        begin, end = _ones(is_open)
        at = np.flatnonzero(is_open)
        far = away[at] > np.repeat(end - begin, end - begin) + half - 1
        if not far.any():
            break
        is_open[at[far]] = False
    begin, end = _ones(is_open)
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    limit = np.concatenate([np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
    until = np.minimum(2 * end - begin + 2 * half - 1, limit[np.searchsorted(limit, begin, "right")])
    furthest = np.maximum.accumulate(until)
    new = np.concatenate([[True], begin[1:] >= furthest[:-1]])
    return np.stack([begin[new], np.maximum.reduceat(until, np.flatnonzero(new))], 1)


def _ones(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


# ---------------------------------------------------------------- Lyndon arrays


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place, from the first phase of suffix sorting.

    Places are grouped by symbol, and groups are taken from the highest down.  Each place of
    the taken group looks for the nearest one before it that no group has taken yet.  That
    place's word ends where the taken group's words begin, so it grows by one of them for each
    place that found it.  Those that grew form groups of their own right above their old
    one, more growth above less.  A place's word is final when its group is taken.
    """
    n = len(ranks)
    first: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        first.setdefault(r, []).append(i)
    members = [first[r] for r in sorted(first)]
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for number, own in enumerate(members):
        for i in own:
            group[i] = number
    before, taken, word = [-1] * n, bytearray(n), [1] * n
    now = len(members) - 1
    while now >= 0:
        size = length[now]
        times: dict[int, int] = {}
        for i in sorted(i for i in members[now] if group[i] == now):
            taken[i] = 1
            word[i] = size
            j = i - 1
            while j >= 0 and taken[j]:
                j = before[j]
            k = i - 1
            while k > j:
                before[k], k = j, before[k]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        grown: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            grown.setdefault((group[j], k), []).append(j)
        for old, k in sorted(grown, reverse=True):
            # Later ones, with less growth, go between the old group and the earlier ones.
            number, upper = len(members), above[old]
            members.append(grown[old, k])
            length.append(length[old] + k * size)
            below.append(old)
            above.append(upper)
            below[upper] = above[old] = number
            for j in grown[old, k]:
                group[j] = number
        now = below[now]
    return word


# ---------------------------------------------------------------- runs


class Windows:
    """Names of all windows of 1, 2, 4, ... places: equal names, equal windows."""

    def __init__(self, codes: np.ndarray):
        self.names = [np.unique(codes, return_inverse=True)[1]]
        size = 1
        while 2 * size <= len(codes):
            last = self.names[-1]
            self.names.append(np.unique(last[:-size] * (len(codes) + 1) + last[size:], return_inverse=True)[1])
            size *= 2

    def forth(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many places from ``i`` on equal those from ``j`` on, for ``i < j``."""
        n, out = len(self.names[0]), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(j + out + (1 << k) <= n)
            a, b = i[fits] + out[fits], j[fits] + out[fits]
            out[fits[self.names[k][a] == self.names[k][b]]] += 1 << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many places before ``i`` equal those before ``j``, for ``i < j``."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(i - out - (1 << k) >= 0)
            a, b = i[fits] - out[fits] - (1 << k), j[fits] - out[fits] - (1 << k)
            out[fits[self.names[k][a] == self.names[k][b]]] += 1 << k
        return out


def runs_of(parts: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """Per sequence of codes its runs as rows ``start, length, period``, by start, then period.

    Every run has a longest Lyndon word of its period under one of both orders.  Each such
    word is extended to both sides as far as its period lasts.
    """
    if not parts:
        return []
    sizes = np.array([len(p) for p in parts])
    # A mark of its own after every sequence, which nothing equals.
    top = max(int(p.max()) for p in parts if len(p)) + 1 if sizes.any() else 0
    joined = np.concatenate([x for k, p in enumerate(parts) for x in (p.astype(np.int64), [top + k])])
    begin = np.cumsum(sizes + 1) - sizes - 1
    windows, found = Windows(joined), []
    for sign in (1, -1):
        period = np.concatenate([np.array([*lyndon_array((sign * p).tolist()), 1], np.int64) for p in parts])
        at = np.flatnonzero(joined < top)
        p = period[at]
        start = at - windows.back(at, at + p)
        end = at + p + windows.forth(at, at + p)
        good = (end - start >= 2 * p) & (end - start >= shortest)
        found.append(np.stack([start, end - start, p], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], [*begin, len(joined)])
    return [rows[s:e] - [b, 0, 0] for s, e, b in zip(edges[:-1], edges[1:], begin, strict=True)]


def _first_pass(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` places no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def find_loops(videos: DataFrame, key: str = "video_id", labels: str = "labels", shortest: int = SHORTEST) -> DataFrame:
    """Looped footage: stretches in which a video's frame labels repeat with a period.

    ``labels`` holds one label per frame, ARRAY<STRING> (null is a label like any other) or a
    STRING of labels between ASCII white space.  Returns per row ``key, n_frames``,
    ``loops ARRAY<STRUCT<start_frame, length, period>>`` and ``once``: the labels, in the type
    they came in (joined by one blank), without the frames that a loop holds after its first
    period.  A loop is a stretch with smallest period q, at least ``max(shortest, 2 q)`` frames
    long, that no neighbouring frame extends; loops may overlap, and are ordered by start,
    then period.

    Null labels count as none.  Null and repeated keys stay rows of their own, further columns are
    ignored.  Sequences are read whole.  Work is linear but for two sorts: ranges
    where no run can lie are left out by an exact test (:func:`repeating_stretches`), and one
    row is never split, so the longest sequence bounds the memory of a task.
    """
    kind = videos.schema[key].dataType.simpleString()
    listed = isinstance(videos.schema[labels].dataType, T.ArrayType)
    once_type = "array<string>" if listed else "string"
    loop = pa.struct([("start_frame", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches) if listed else small_batches(batches, "labels"):
            column = batch["labels"]
            rows = column.to_pylist() if listed else [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]
            rows = [r or [] for r in rows]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = pa.array(list(chain.from_iterable(rows)), pa.large_string() if listed else pa.large_binary())
            codes = flat.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(rows)), sizes)
            ranges = repeating_stretches(codes, owner, shortest)
            found: dict[int, list[np.ndarray]] = {}
            for (s, e), runs in zip(ranges.tolist(), runs_of([codes[s:e] for s, e in ranges], shortest), strict=True):
                if len(runs):
                    found.setdefault(int(owner[s]), []).append(runs + [s - edges[owner[s]], 0, 0])
            loops, once = [], []
            for number, own in enumerate(rows):
                runs = np.concatenate(found[number]) if number in found else np.zeros((0, 3), np.int64)
                if len(runs):
                    own = [own[i] for i in np.flatnonzero(_first_pass(len(own), runs))]
                loops.append([dict(zip(("start_frame", "length", "period"), r, strict=True)) for r in runs.tolist()])
                once.append(own if listed else b" ".join(own).decode())
            yield pa.record_batch(
                [batch["key"], pa.array(sizes), pa.array(loops, pa.list_(loop)), pa.array(once, pa.list_(pa.string()) if listed else pa.string())],
                names=["key", "n_frames", "loops", "once"],
            )

    return (
        videos.select(F.col(key).alias("key"), F.col(labels).alias("labels"))
        .mapInArrow(
            find,
            f"key {kind}, n_frames bigint, loops array<struct<start_frame: bigint, length: bigint, period: bigint>>, once {once_type}",
        )
        .withColumnRenamed("key", key)
    )


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
