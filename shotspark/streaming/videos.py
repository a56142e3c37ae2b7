"""Chunks of live videos to transitions, scenes and tracks as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotspark.operators.tracking import TrackParams, _Live
from shotspark.streaming.folds import ChunkRanges, Pending, own_gradual_step
from shotspark.streaming.operators import Expiry, _event_time, _run

GRADUAL, HARD = "gradual_transition", "hard_cut"


@dataclass
class Chunk:
    """What the models report for one chunk, in video coordinates.

    ``boxes`` rows are ``frame, detector, det_idx, conf, x1, y1, x2, y2``; ``shown`` tells which of
    them may be published.
    """

    index: int
    valid_start: int
    ranges: ChunkRanges
    cuts: list[tuple[int, float]]
    boxes: np.ndarray
    shown: np.ndarray


@dataclass
class VideoState:
    """All that chunks hand on: the open gradual, the scene that is running, and its live tracks."""

    pending: Pending = field(default_factory=Pending)
    #: Transitions so far, the last frame one of them ends in, and those that end there.
    count: int = 0
    last_end: int = -1
    at_end: list[tuple[str, int]] = field(default_factory=list)
    #: The scene whose tracks are live, the tracks, and their published numbers (-1: none yet).
    scene: int = -1
    live: _Live = field(default_factory=_Live)
    numbers: dict[int, int] = field(default_factory=dict)
    next_track: int = 0


def chunk_step(s: VideoState, chunk: Chunk, params: TrackParams) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Transitions, scenes and published boxes that become final with the next chunk in order.

    A chunk emits no transition that ends before the last frame of the one before it, and a
    frame's scene is the number of transitions that end before it.  So all frames of a chunk
    have their scene once the chunk is there, even while a gradual is still open.
    """
    graduals = own_gradual_step(s.pending, chunk.ranges)
    hard = [
        (f, f, c) for f, c in chunk.cuts
        if chunk.ranges.valid_start <= f <= chunk.ranges.valid_end and not any(a <= f <= b for a, b, _ in graduals)
    ]
    found: dict[tuple[int, int, str], float] = {}
    for kind, own in ((GRADUAL, graduals), (HARD, hard)):
        for a, b, c in own:
            found[b, a, kind] = max(c, found.get((b, a, kind), c))
    transitions, scenes, ends = [], [], []
    for (end, start, kind), confidence in sorted(found.items()):
        if end == s.last_end and (kind, start) in s.at_end:
            # The chunk before told it already.
            continue
        transitions.append((kind, start, end, confidence))
        if s.last_end + 1 <= end:
            scenes.append((s.count, s.last_end + 1, end))
            s.at_end = []
        s.count, s.last_end = s.count + 1, max(s.last_end, end)
        s.at_end.append((kind, start))
        ends.append(end)
    if chunk.ranges.is_last and s.last_end < chunk.ranges.valid_end:
        scenes.append((s.count, s.last_end + 1, chunk.ranges.valid_end))
    return transitions, scenes, _tracks(s, chunk, np.array(ends), params)


def _tracks(s: VideoState, chunk: Chunk, ends: np.ndarray, params: TrackParams) -> list[tuple]:
    """Boxes frame by frame; tracks end with their scene, and number as they are first shown."""
    out = []
    use = (chunk.boxes[:, 0] >= chunk.valid_start) & (chunk.boxes[:, 0] <= chunk.ranges.valid_end) & (chunk.boxes[:, 3] >= params.low)
    boxes, shown = chunk.boxes[use], chunk.shown[use]
    order = np.lexsort((boxes[:, 2], boxes[:, 1], boxes[:, 0]))
    boxes, shown = boxes[order], shown[order]
    before = s.count - len(ends)
    frames = boxes[:, 0]
    cuts = np.flatnonzero(np.diff(frames)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(frames)], strict=True):
        if a == b:
            continue
        frame = int(frames[a])
        scene = before + int(np.searchsorted(ends, frame))
        if scene != s.scene:
            s.scene, s.live, s.numbers, s.next_track = scene, _Live(), {}, 0
        ids = s.live.step(frame, boxes[a:b, 4:], boxes[a:b, 3], params)
        for k in np.flatnonzero((ids >= 0) & shown[a:b]).tolist():
            raw = int(ids[k])
            if raw not in s.numbers:
                s.numbers[raw], s.next_track = s.next_track, s.next_track + 1
            out.append((scene, *boxes[a + k].tolist(), s.numbers[raw]))
    known = set(s.live.ids.tolist())
    s.numbers = {raw: n for raw, n in s.numbers.items() if raw in known}
    return out


# ---------------------------------------------------------------- the stream

_STATE = (
    "next BIGINT, start BIGINT, confidence DOUBLE, count BIGINT, last_end BIGINT, end_types ARRAY<STRING>, end_starts ARRAY<BIGINT>, "
    "scene BIGINT, next_id BIGINT, next_track BIGINT, ids ARRAY<BIGINT>, seen ARRAY<BIGINT>, boxes ARRAY<DOUBLE>, numbers ARRAY<BIGINT>"
)
_BOX = ("frame", "detector", "det_idx", "conf", "x1", "y1", "x2", "y2")
_CHUNK = (
    "valid_start BIGINT, valid_end BIGINT, context_end BIGINT, is_last BOOLEAN, cut_frames ARRAY<BIGINT>, cut_confidences ARRAY<DOUBLE>, "
    "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, confidences ARRAY<DOUBLE>, box_values ARRAY<DOUBLE>, box_classes ARRAY<STRING>, width DOUBLE, height DOUBLE"
)
_OUT = (
    "video_id BIGINT, chunk_index BIGINT, kind STRING, type STRING, start_frame BIGINT, end_frame BIGINT, confidence DOUBLE, scene_no BIGINT, "
    "frame BIGINT, detector BIGINT, det_idx BIGINT, class_name STRING, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, track_id BIGINT"
)


class _Videos(StatefulProcessor):
    """Chunks may arrive in any order; a chunk waits until its predecessors are done."""

    def __init__(self, params: TrackParams, emit: float) -> None:
        self.params, self.emit = params, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getMapState("waiting", "chunk_index BIGINT", _CHUNK)

    def forget(self) -> None:
        self.state.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.chunk_index >= s.pending.next_chunk:
                    values = (getattr(row, n) for n in names)
                    self.waiting.updateValue((int(row.chunk_index),), tuple(list(v) if isinstance(v, np.ndarray) else v for v in values))
        out = []
        while self.waiting.containsKey((s.pending.next_chunk,)):
            index = s.pending.next_chunk
            chunk, classes = self._chunk(index, self.waiting.getValue((index,)))
            self.waiting.removeKey((index,))
            transitions, scenes, boxes = chunk_step(s, chunk, self.params)
            nothing = (None,) * 10
            out += [(key[0], index, "transition", *t, None, *nothing) for t in transitions]
            out += [(key[0], index, "scene", None, a, b, None, n, *nothing) for n, a, b in scenes]
            for scene, frame, detector, det_idx, conf, *corners, track in boxes:
                name = classes[int(frame), int(detector), int(det_idx)]
                own = (int(frame), int(detector), int(det_idx), name, conf, *corners, track)
                out.append((key[0], index, "box", None, None, None, None, scene, *own))
        self._save(s)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype(object)

    def _load(self) -> VideoState:
        if not self.state.exists():
            return VideoState()
        (following, start, confidence, count, last_end, types, starts, scene, next_id, next_track, ids, seen, boxes, numbers) = self.state.get()
        live = _Live()
        live.ids, live.seen = np.array(list(ids), np.int64), np.array(list(seen), np.int64)
        live.boxes, live.next_id = np.array(list(boxes), float).reshape(-1, 4), next_id
        shown = {int(i): int(n) for i, n in zip(ids, numbers, strict=True) if n >= 0}
        at_end = list(zip(types, starts, strict=True))
        return VideoState(Pending(following, start, confidence), count, last_end, at_end, scene, live, shown, next_track)

    def _save(self, s: VideoState) -> None:
        ids = s.live.ids.tolist()
        self.state.update(
            (
                s.pending.next_chunk, s.pending.start, float(s.pending.confidence), s.count, s.last_end, [k for k, _ in s.at_end],
                [a for _, a in s.at_end], s.scene, int(s.live.next_id), s.next_track, ids, s.live.seen.tolist(),
                s.live.boxes.ravel().tolist(), [s.numbers.get(i, -1) for i in ids],
            )
        )

    def _chunk(self, index: int, value: tuple) -> tuple[Chunk, dict]:
        first, last, context, is_last, cuts, cut_conf, starts, ends, confs, values, classes, width, height = value
        ranges = ChunkRanges(context, first, last, is_last, list(zip(map(int, starts), map(int, ends), map(float, confs), strict=True)))
        boxes = np.array(list(values), float).reshape(-1, len(_BOX))
        wide = np.clip(boxes[:, [4, 6]], 0, np.inf if width is None else width)
        high = np.clip(boxes[:, [5, 7]], 0, np.inf if height is None else height)
        named = np.array([c is not None for c in classes], bool)
        shown = (boxes[:, 3] >= self.emit) & named & (wide[:, 1] > wide[:, 0]) & (high[:, 1] > high[:, 0])
        names = {tuple(map(int, b[:3])): c for b, c in zip(boxes.tolist(), classes, strict=True)}
        return Chunk(index, first, ranges, list(zip(map(int, cuts), map(float, cut_conf), strict=True)), boxes, shown), names


def videos_stream(
    chunk_messages: DataFrame, params: TrackParams = TrackParams(), emit: float = 0.5, expiry: Expiry | None = None
) -> DataFrame:
    """Ownership of transitions, scenes and tracks of live videos, chunk by chunk.

    One message per chunk, in any order: its ranges ``valid_start, valid_end, context_end,
    is_last``, the frame size ``width, height`` (NULL: no clipping), ``cuts ARRAY<STRUCT<frame, confidence>>``,
    ``graduals ARRAY<STRUCT<start_frame, end_frame, confidence>>`` and fused ``boxes ARRAY<STRUCT<frame,
    detector, det_idx, class_name, conf, x1, y1, x2, y2>>``, all in video coordinates.  Out come rows of three
    ``kind``: ``transition``, ``scene``, and ``box`` with its ``scene_no`` and ``track_id``,
    each once, when it is final; together they are what the batch operators give for whole
    videos.  Live tracks pass from chunk to chunk and end with their scene.

    A video's state is one open gradual, one scene and its live tracks, besides chunks that
    wait for an earlier one; with ``expiry`` it goes when the video falls silent.
    """
    numbers = [F.col(f"boxes.{c}").cast("array<double>") for c in _BOX]
    values = F.flatten(F.transform(F.arrays_zip(*[n.alias(c) for n, c in zip(numbers, _BOX, strict=True)]), lambda b: F.array(*[b[c] for c in _BOX])))
    rows = chunk_messages.select(
        "video_id", "chunk_index", "valid_start", "valid_end", "context_end", "is_last",
        F.col("cuts.frame").alias("cut_frames"), F.col("cuts.confidence").alias("cut_confidences"),
        F.col("graduals.start_frame").alias("starts"), F.col("graduals.end_frame").alias("ends"), F.col("graduals.confidence").alias("confidences"),
        values.alias("box_values"), F.col("boxes.class_name").alias("box_classes"),
        F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), *_event_time(expiry),
    )
    return _run(rows, ["video_id"], _Videos(params, emit), _OUT, expiry)
