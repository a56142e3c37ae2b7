"""Per-scene track association."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.operators.ordered import BLOCK, islands, locate, scan
from shotspark.session import durable

SCENE = ["video_id", "scene_no"]


@dataclass(frozen=True)
class TrackParams:
    high: float = 0.50
    low: float = 0.10
    new: float = 0.55
    buffer: int = 45
    match: float = 0.75
    second_match: float = 0.5
    fuse_score: bool = True


def assign_scene(dets: DataFrame, scenes: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Add ``scene_no`` to every box inside a scene; boxes outside all scenes drop out."""
    held = scenes.select("video_id", "scene_no", F.col("start_frame").alias("__from"), F.col("end_frame").alias("__to"))
    return locate(dets, held, ["video_id"], "frame", "__from", "__to", ["scene_no"], width=block).drop("__from", "__to")


def keep_valid(dets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Boxes within the valid range of the chunk that reported them; drops ``chunk_index``.

    Chunks overlap, so a frame is seen by several; it is valid in one of them only.
    """
    valid = chunks.select("video_id", "chunk_index", F.col("valid_start").alias("__from"), F.col("valid_end").alias("__to"))
    kept = dets.join(valid, ["video_id", "chunk_index"]).where(F.col("frame").between(F.col("__from"), F.col("__to")))
    return kept.drop("chunk_index", "__from", "__to")


def tracker_resets(scenes: DataFrame, transitions: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Where the tracker starts afresh.

    ``scenes`` are intervals per chunk.  A reset happens when the interval starts right
    after a transition of the same chunk, or when its scene differs from the interval before.
    """
    anchors = transitions.select(
        "video_id", "chunk_index", (F.col("end_frame") + 1).alias("start_frame"), F.lit(True).alias("after_cut")
    ).distinct()
    known = scan(scenes, ["video_id"], F.col("start_frame"), width=block, previous={"__before": F.col("scene_no")})
    return known.join(anchors, ["video_id", "chunk_index", "start_frame"], "left").select(
        *scenes.columns,
        F.coalesce("after_cut", F.lit(False)).alias("after_cut"),
        (~F.col("scene_no").eqNullSafe(F.col("__before"))).alias("scene_changed"),
    )


# ---------------------------------------------------------------- association


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    size = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - low, 0.0)
    inter = size[..., 0] * size[..., 1]
    first, second = ((x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b))
    union = first[:, None] + second[None, :] - inter
    return inter / np.where(union > 0, union, 1.0)


def _assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs that minimise total cost, where leaving a pair out costs ``limit``.

    If every row of the shorter side prefers another column, those preferences are optimal;
    only true contests go through the shortest-path method.
    """
    flip = cost.shape[0] > cost.shape[1]
    cost = cost.T if flip else cost
    m, allowed = np.minimum(cost - limit, 0.0), cost <= limit
    rows = np.flatnonzero(allowed.any(axis=1))
    if not len(rows):
        return []
    best = np.argmin(np.where(allowed[rows], m[rows], 1.0), axis=1)
    if len(set(best.tolist())) == len(best):
        pairs = list(zip(rows.tolist(), best.tolist()))
    else:
        cols = np.flatnonzero(allowed[rows].any(axis=0))
        found = _shortest_paths(m[np.ix_(rows, cols)])
        pairs = [(int(rows[i]), int(cols[j])) for i, j in found if allowed[rows[i], cols[j]]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def _shortest_paths(m: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns by successive shortest paths."""
    if m.shape[0] > m.shape[1]:
        return [(i, j) for j, i in _shortest_paths(m.T)]
    n_rows, n_cols = m.shape
    u, v = np.zeros(n_rows + 1), np.zeros(n_cols + 1)
    row_of = np.zeros(n_cols + 1, dtype=int)
    for i in range(1, n_rows + 1):
        row_of[0], j0 = i, 0
        dist, came = np.full(n_cols + 1, np.inf), np.zeros(n_cols + 1, dtype=int)
        done = np.zeros(n_cols + 1, dtype=bool)
        while row_of[j0]:
            done[j0] = True
            i0 = row_of[j0]
            reduced = m[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (reduced < dist[1:])
            dist[1:][better], came[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(done[1:], np.inf, dist[1:]))) + 1
            delta = dist[j1]
            u[row_of[done]] += delta
            v[done] -= delta
            dist[~done] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[came[j0]]
            j0 = came[j0]
    return [(int(row_of[j]) - 1, j - 1) for j in range(1, n_cols + 1) if row_of[j]]


class _Live:
    """Live tracks of one segment: all the state association ever needs."""

    def __init__(self) -> None:
        self.ids = np.empty(0, dtype=np.int64)
        self.boxes = np.empty((0, 4))
        self.seen = np.empty(0, dtype=np.int64)
        self.next_id = 0

    def arrange(self) -> None:
        """Bring tracks into an order that depends on what they are, not on how they came.

        Ties of an assignment go by position, so pieces that inherit equal tracks do the same.
        """
        order = np.lexsort((*self.boxes.T[::-1], self.seen))
        self.ids, self.boxes, self.seen = self.ids[order], self.boxes[order], self.seen[order]

    def inherit(self, boxes: np.ndarray, seen: np.ndarray) -> None:
        """Take over tracks in slot order; they are numbered by their slot."""
        self.ids = np.concatenate([self.ids, np.arange(self.next_id, self.next_id + len(seen))])
        self.boxes = np.concatenate([self.boxes, boxes])
        self.seen = np.concatenate([self.seen, seen.astype(np.int64)])
        self.next_id += len(seen)

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray, p: TrackParams) -> np.ndarray:
        """Track id per detection of this frame, -1 where it joins none."""
        alive = frame - self.seen <= p.buffer
        if not alive.all():
            self.ids, self.boxes, self.seen = self.ids[alive], self.boxes[alive], self.seen[alive]
        self.arrange()
        got = np.full(len(conf), -1, dtype=np.int64)
        free = np.arange(len(self.ids))
        for members, limit, fuse in (
            (np.flatnonzero(conf >= p.high), p.match, p.fuse_score),
            (np.flatnonzero((conf > p.low) & (conf < p.high)), p.second_match, False),
        ):
            if not len(free) or not len(members):
                continue
            similarity = _iou_matrix(self.boxes[free], boxes[members])
            if fuse:
                similarity = similarity * conf[members][None, :]
            pairs = _assign(1.0 - similarity, limit)
            for t, d in pairs:
                got[members[d]] = self.ids[free[t]]
                self.boxes[free[t]] = boxes[members[d]]
                self.seen[free[t]] = frame
            left = np.ones(len(free), dtype=bool)
            left[[t for t, _ in pairs]] = False
            free = free[left]
        fresh = np.flatnonzero((got < 0) & (conf >= p.new))
        if len(fresh):
            ids = np.arange(self.next_id, self.next_id + len(fresh))
            self.next_id += len(fresh)
            got[fresh] = ids
            self.ids = np.concatenate([self.ids, ids])
            self.boxes = np.concatenate([self.boxes, boxes[fresh]])
            self.seen = np.concatenate([self.seen, np.full(len(fresh), frame)])
        return got


UNIT = ["video_id", "scene_no", "segment", "piece"]
_STATE, _BOX = 0, 1


def _track_batches(p: TrackParams, piece_frames: int):
    """Fold over sorted units, a batch at a time; only live tracks stay in memory.

    A unit is one piece of a segment.  Its rows are the tracks it inherits (``kind`` 0, by
    slot) and then its boxes (``kind`` 1, by frame).  Out come the boxes that joined a track
    and, if the segment goes on, the tracks handed to the next piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit: tuple | None = None
        live, sample = _Live(), None

        def handed_over() -> Iterator[pd.DataFrame]:
            if unit is None or sample["last_piece"].iloc[0] <= unit[3]:
                return
            live.arrange()
            border = unit[2] + (unit[3] + 1) * piece_frames
            keep = np.flatnonzero(border - live.seen <= p.buffer)
            if len(keep):
                boxes = live.boxes[keep]
                yield sample.iloc[np.zeros(len(keep), dtype=int)].assign(
                    kind=_STATE, slot=np.arange(len(keep)), frame=live.seen[keep], raw_id=live.ids[keep],
                    x1=boxes[:, 0], y1=boxes[:, 1], x2=boxes[:, 2], y2=boxes[:, 3],
                )

        def consume(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal unit, live, sample
            who = pdf[UNIT].to_numpy(dtype=np.int64)
            kind, frame = pdf["kind"].to_numpy(), pdf["frame"].to_numpy()
            boxes = pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)
            conf = pdf["conf"].to_numpy(dtype=float)
            step = (who[1:] != who[:-1]).any(axis=1) | (kind[1:] != kind[:-1]) | (frame[1:] != frame[:-1])
            cuts = np.flatnonzero(step) + 1
            ids = np.full(len(pdf), -1, dtype=np.int64)
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
                mine = tuple(who[a])
                if mine != unit:
                    yield from handed_over()
                    unit, live, sample = mine, _Live(), pdf.iloc[[a]]
                if kind[a] == _STATE:
                    live.inherit(boxes[a:b], frame[a:b])
                else:
                    ids[a:b] = live.step(int(frame[a]), boxes[a:b], conf[a:b], p)
            yield pdf.assign(raw_id=ids)[ids >= 0]

        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # The last frame may go on in the next batch.
            key = pdf[[*UNIT, "kind", "frame"]].to_numpy(dtype=np.int64)
            first = int(np.argmax((key == key[-1]).all(axis=1)))
            held, ready = pdf.iloc[first:], pdf.iloc[:first]
            if len(ready):
                yield from consume(ready.reset_index(drop=True))
        if held is not None:
            yield from consume(held.reset_index(drop=True))
        yield from handed_over()

    return run


def track_segments(dets: DataFrame, params: TrackParams = TrackParams(), *, block: int = BLOCK) -> DataFrame:
    """Parts of scenes that no track can outlive: ``segment`` (first frame) to ``last_frame``.

    They are separated by more than ``buffer`` frames without a candidate box, after which
    every track is dead, so segments are independent of each other.
    """
    busy = dets.where(F.col("conf") >= params.low).select(*SCENE, "frame").distinct()
    parts = islands(busy, SCENE, F.col("frame"), F.col("frame"), gap=params.buffer - 1, width=block)
    return parts.select(*SCENE, F.col("start").alias("segment"), F.col("end").alias("last_frame"))


def _units(dets: DataFrame, segments: DataFrame, params: TrackParams, piece_frames: int, block: int) -> DataFrame:
    """Candidate boxes with their segment and the piece of ``piece_frames`` frames in it."""
    return locate(
        dets.where(F.col("conf") >= params.low), segments, SCENE, "frame", "segment", "last_frame", width=block
    ).select(
        *dets.columns, "segment",
        F.expr(f"(frame - segment) div {piece_frames}").alias("piece"),
        F.expr(f"(last_frame - segment) div {piece_frames}").alias("last_piece"),
        F.lit(_BOX).alias("kind"),
        F.lit(0).cast("bigint").alias("slot"),
    )


def associate_tracks(
    dets: DataFrame, params: TrackParams = TrackParams(), *, piece_frames: int = 4096, block: int = BLOCK
) -> DataFrame:
    """Boxes with ``scene_no`` to raw tracks: adds ``segment`` and ``raw_id``.

    Confident boxes are matched to live tracks first, weak boxes only to what is left; an
    unmatched confident box starts a track; a track ends after ``buffer`` frames unseen.  A
    track is its last box, without a motion model: weak boxes may also revive a track that
    the last frame missed, and a new track counts from its first frame.

    Pieces of a segment run side by side.  Each first assumes that it inherits no track; a
    piece whose predecessor in fact hands over something else runs again with that, until
    every piece has used what it really inherits.  That fixed point is the sequential result.
    Tracks are handed over and tried in an order of their content, so it is reached as soon as
    the set of live tracks at a border is right, which recent boxes alone decide: two or three
    rounds, however many pieces there are.
    """
    if piece_frames <= params.buffer:
        raise ValueError("piece_frames must exceed the track buffer")
    rows = _units(dets, track_segments(dets, params, block=block), params, piece_frames, block)
    schema = T.StructType([*rows.schema.fields, T.StructField("raw_id", T.LongType())])

    def run(units: DataFrame) -> DataFrame:
        ordered = units.repartition(*UNIT).sortWithinPartitions(*UNIT, "kind", "slot", "frame", "detector", "det_idx")
        return durable(ordered.mapInPandas(_track_batches(params, piece_frames), schema))

    keep = [*dets.columns, "segment", "raw_id"]
    rows = durable(rows)
    first = run(rows)
    if rows.where("last_piece > 0").isEmpty():
        # No segment is longer than a piece, so nothing was handed over.
        return first.withColumn("raw_id", F.col("raw_id").cast("bigint")).select(*keep)

    # What each piece was given, by the round that gave it; round 0 gave nothing.
    content = F.array_sort(F.collect_list(F.struct("slot", "frame", "x1", "y1", "x2", "y2")))
    rounds = [first]
    given = rows.where("last_piece > 0").select(*UNIT).distinct().withColumns(
        {"round": F.lit(0), "used": F.array().cast("array<struct<slot:bigint,frame:bigint,x1:double,y1:double,x2:double,y2:double>>")}
    )
    given = durable(given)
    while True:
        handed = _latest(rounds, given).where(F.col("kind") == _STATE).withColumn("piece", F.col("piece") + 1)
        due = given.join(handed.groupBy(*UNIT).agg(content.alias("due")), UNIT, "left")
        due = due.withColumn("due", F.coalesce("due", F.array().cast(given.schema["used"].dataType)))
        changed = durable(due.where(F.col("due") != F.col("used")).select(*UNIT, "due"))
        if changed.isEmpty():
            break
        again = rows.join(changed.select(*UNIT), UNIT, "left_semi")
        states = handed.join(changed.select(*UNIT), UNIT, "left_semi").drop("raw_id")
        rounds.append(run(again.unionByName(states)))
        given = durable(
            given.join(changed, UNIT, "left").select(
                *UNIT,
                F.when(F.col("due").isNotNull(), len(rounds) - 1).otherwise(F.col("round")).alias("round"),
                F.coalesce("due", "used").alias("used"),
            )
        )
    final = _latest(rounds, given)
    roots = _track_roots(final)
    boxes = final.where(F.col("kind") == _BOX).join(roots, [*UNIT, "raw_id"], "left")
    # Born in this piece unless the chain of hand-overs leads further back.
    born = F.coalesce("root_piece", "piece") * F.lit(1 << 32) + F.coalesce("root_id", "raw_id")
    return boxes.withColumn("raw_id", born).select(*keep)


def _latest(rounds: list[DataFrame], given: DataFrame) -> DataFrame:
    """Each piece's rows from its last run; pieces of short segments ran once."""
    out = rounds[0].where("last_piece = 0")
    for n, part in enumerate(rounds):
        mine = given.where(F.col("round") == n).select(*UNIT)
        out = out.unionByName(part.where("last_piece > 0").join(mine, UNIT, "left_semi"))
    return out


def _track_roots(final: DataFrame) -> DataFrame:
    """For tracks that a piece inherited: the piece and id under which they were born.

    Inherited tracks carry their slot as id, and the hand-over names the id in the piece
    before.  Following the links doubles its reach in every round.
    """
    at = ["video_id", "scene_no", "segment"]
    links = final.where(F.col("kind") == _STATE).select(
        *at, (F.col("piece") + 1).alias("piece"), F.col("slot").alias("raw_id"),
        F.col("piece").alias("root_piece"), F.col("raw_id").alias("root_id"),
    )
    links = durable(links)
    while True:
        up = links.select(
            *at, F.col("piece").alias("root_piece"), F.col("raw_id").alias("root_id"),
            F.col("root_piece").alias("__p"), F.col("root_id").alias("__i"),
        )
        moved = links.join(up, [*at, "root_piece", "root_id"], "left")
        if moved.where("__p is not null").isEmpty():
            return links
        links = durable(
            moved.select(
                *at, "piece", "raw_id",
                F.coalesce("__p", "root_piece").alias("root_piece"), F.coalesce("__i", "root_id").alias("root_id"),
            )
        )


def dense_track_ids(raw: DataFrame, order: tuple[str, ...] = ("detector", "det_idx"), *, block: int = BLOCK) -> DataFrame:
    """Per scene, tracks numbered 0, 1, 2, ... by their first emitted row.

    ``raw`` holds the emitted rows only; ``(frame, *order)`` is the emission order.
    """
    track = [*SCENE, "segment", "raw_id"]
    firsts = raw.groupBy(*track).agg(F.min(F.struct("frame", *order)).alias("f")).select(*track, "f.*")
    ranked = scan(firsts, SCENE, F.col("frame"), list(order), width=block, rank="track_id")
    return raw.join(ranked.select(*track, "track_id"), track)
