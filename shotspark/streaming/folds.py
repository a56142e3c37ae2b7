"""Per-key folds behind the streaming operators: plain functions, one step each.

They hold the order-dependent rule of an operator and nothing about Spark, so the tests can
compare them with the relational batch form row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from shotspark.operators.status import NEXT_STAGES, STAGE_RANK, TERMINAL


def publish_step(expected: int, chunk_index: int) -> tuple[int, str]:
    """H3: next expected chunk and the outcome of one attempt."""
    if chunk_index == expected:
        return expected + 1, "published"
    return expected, "duplicate" if chunk_index < expected else "rejected"


@dataclass
class Status:
    """The stored status of one task."""

    stage: str = "queued"
    progress: float = 0.0
    message: str | None = None
    total_chunks: int = 0
    cut_completed: int = 0
    tracking_completed: int = 0
    error_code: str | None = None
    error_detail: str | None = None
    processing_started_us: int | None = None
    updated_us: int | None = None


def status_step(s: Status, u: dict) -> str:
    """Apply one update in place; returns applied, stale, ignored or rejected."""
    if s.stage in TERMINAL:
        return "ignored"
    asked = u.get("stage") or ""
    verdict = "applied"
    if asked and asked != s.stage:
        if asked in NEXT_STAGES[s.stage]:
            s.stage = asked
        elif STAGE_RANK[asked] < STAGE_RANK[s.stage]:
            verdict = "stale"
        else:
            return "rejected"
    progress = u.get("progress")
    if progress is not None:
        s.progress = max(s.progress, progress)
    if u.get("message") and verdict == "applied" and (progress is None or progress >= s.progress):
        s.message = u["message"]
    for counter in ("total_chunks", "cut_completed", "tracking_completed"):
        setattr(s, counter, max(getattr(s, counter), int(u.get(counter) or 0)))
    s.error_code = u.get("error_code") or s.error_code
    s.error_detail = (u.get("error_detail") or "")[:2000] or s.error_detail
    if s.processing_started_us is None and s.stage != "queued":
        s.processing_started_us = u["ts_us"]
    s.updated_us = u["ts_us"]
    return verdict


@dataclass
class Pending:
    """the gradual left open by the previous chunk, if any."""

    next_chunk: int = 0
    start: int | None = None
    confidence: float = 0.0


@dataclass
class ChunkRanges:
    context_end: int
    valid_start: int
    valid_end: int
    is_last: bool
    graduals: list[tuple[int, int, float]] = field(default_factory=list)


def own_gradual_step(state: Pending, chunk: ChunkRanges) -> list[tuple[int, int, float]]:
    """graduals this chunk emits; ``state`` moves on to the next chunk."""
    border = chunk.valid_start - 1
    left = sorted(chunk.graduals)
    emitted: list[tuple[int, int, float]] = []
    open_now: list[tuple[int, float]] = []

    def settle(start: int, end: int, confidence: float) -> None:
        if end == chunk.context_end and not chunk.is_last:
            open_now.append((start, confidence))
        elif end <= chunk.valid_end:
            emitted.append((start, end, confidence))

    if state.start is not None:
        spanning = [g for g in left if g[0] <= border <= g[1]]
        if spanning:
            start, end, confidence = spanning[0]
            left.remove(spanning[0])
            settle(min(state.start, start), end, max(state.confidence, confidence))
        else:
            emitted.append((state.start, border, state.confidence))
    for start, end, confidence in left:
        if end >= chunk.valid_start:
            settle(start, end, confidence)
    state.next_chunk += 1
    state.start = min((s for s, _ in open_now), default=None)
    state.confidence = max((c for _, c in open_now), default=0.0)
    return emitted
