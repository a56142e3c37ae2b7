"""Task status: stage machine, progress and its folds (I)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.operators.blocks import sorted_by, whole_groups
from shotspark.operators.ordered import BLOCK, block_start, scan

# Stages with their rank, and the stages each may move on to.
STAGE_RANK = {
    "queued": 0,
    "downloading": 1,
    "decoding": 2,
    "cut_detection": 3,
    "tracking": 4,
    "aggregating": 5,
    "completed": 6,
    "failed": 6,
}
NEXT_STAGES = {
    "queued": ("downloading", "decoding", "failed"),
    "downloading": ("decoding", "failed"),
    "decoding": ("cut_detection", "failed"),
    "cut_detection": ("tracking", "failed"),
    "tracking": ("aggregating", "failed"),
    "aggregating": ("completed", "failed"),
    "completed": (),
    "failed": (),
}
TERMINAL = ("completed", "failed")
#: Longest path through the stages, in moves.
MAX_MOVES = 6


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def stage_rank(stage: Column) -> Column:
    return F.element_at(_table(STAGE_RANK), stage)


def may_follow(current: Column, requested: Column) -> Column:
    """True if the stage table has the edge ``current -> requested``."""
    edges = [f"{a}>{b}" for a, following in NEXT_STAGES.items() for b in following]
    return F.concat_ws(">", current, requested).isin(*edges)


def validate_stage_path(updates: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Each named stage against the one before it (``queued`` at the start)."""
    named = updates.where(F.coalesce("stage", F.lit("")) != "")
    rows = scan(named, ["task_id"], F.col("seq"), width=block, previous={"previous_stage": F.col("stage")})
    before = F.coalesce("previous_stage", F.lit("queued"))
    return rows.withColumn("previous_stage", before).withColumn(
        "valid", (F.col("previous_stage") == F.col("stage")) | may_follow(F.col("previous_stage"), F.col("stage"))
    )


#: Stages by number, and which number may follow which.
STAGES = tuple(STAGE_RANK)
_ALLOWED = np.array([[b in NEXT_STAGES[a] for b in STAGES] for a in STAGES])


class _Walks:
    """Stage moves inside sorted groups of updates, for all groups at once.

    From its stage a group takes the first later update that names an allowed next one.  The
    stages only move forward, so ``MAX_MOVES`` steps exhaust every walk.
    """

    def __init__(self, group: np.ndarray, stage: np.ndarray):
        """``stage`` holds stage numbers, -1 for updates that name none."""
        n = len(group)
        self.group = group
        self.begin = np.flatnonzero(np.diff(group, prepend=-1))
        # The next place at or after each one that names each stage; n is nowhere.
        places = np.where(stage[:, None] == np.arange(len(STAGES)), np.arange(n)[:, None], n)
        self.next = np.append(np.minimum.accumulate(places[::-1], axis=0)[::-1], np.full((1, len(STAGES)), n), axis=0)

    def moves(self, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rounds of ``(groups, places, new stages)`` when every group starts in its stage."""
        n, stage, at = len(self.group), start.copy(), self.begin.copy()
        for _ in range(MAX_MOVES):
            found = np.where(_ALLOWED[stage], self.next[at], n)
            place, new = found.min(axis=1), found.argmin(axis=1)
            own = np.flatnonzero((place < n) & (self.group[np.minimum(place, n - 1)] == np.arange(len(at))))
            if not len(own):
                return
            yield own, place[own], new[own]
            stage[own], at[own] = new[own], place[own] + 1


def _held(n: int, begin: np.ndarray, start: np.ndarray, moves) -> np.ndarray:
    """The stage before every place of groups that begin in ``start``."""
    stage = np.full(n + 1, -1)
    stage[begin] = start
    for _, place, new in moves:
        # A move in the last place of a group is seen by nobody.
        free = ~np.isin(place + 1, begin)
        stage[place[free] + 1] = new[free]
    known = np.maximum.accumulate(np.where(stage >= 0, np.arange(n + 1), 0))
    return stage[known][:n]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.index_in(column, pa.array(STAGES)), -1).to_numpy().astype(np.int64)


def with_current_stage(updates: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Every update with ``current``, the stage of its task before it.

    A block of updates is a function from the eight stages to the stage after it.  Each block
    works out its function, the functions of a task are composed in order, and every block is
    walked again from the stage in which it is entered.  No task is ever gathered.
    """
    part = ["task_id", "__block"]
    task = updates.schema["task_id"].dataType.simpleString()
    rows = updates.withColumn("__block", block_start(F.col("seq"), block))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, part):
            walks = _Walks(group, _numbers(table["stage"]))
            after = np.tile(np.arange(len(STAGES)), (len(walks.begin), 1))
            for s in range(len(STAGES)):
                for own, _, new in walks.moves(np.full(len(walks.begin), s)):
                    after[own, s] = new
            keys = table.select(part).take(pa.array(walks.begin)).combine_chunks()
            lists = pa.FixedSizeListArray.from_arrays(pa.array(after.ravel(), pa.int64()), len(STAGES))
            yield from pa.table([*keys.columns, lists.cast(pa.list_(pa.int64()))], names=[*part, "after"]).to_batches()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["task_id"]):
            after = table["after"].combine_chunks().flatten().to_numpy().reshape(-1, len(STAGES))
            n, begin = len(group), np.flatnonzero(np.diff(group, prepend=-1))
            # The next block at or after each one that leaves each stage.
            places = np.where(after != np.arange(len(STAGES)), np.arange(n)[:, None], n)
            leaves = np.append(np.minimum.accumulate(places[::-1], axis=0)[::-1], np.full((1, len(STAGES)), n), axis=0)
            stage, at, moves = np.zeros(len(begin), np.int64), begin.copy(), []
            for _ in range(MAX_MOVES):
                place = leaves[at, stage]
                own = np.flatnonzero((place < n) & (group[np.minimum(place, n - 1)] == np.arange(len(begin))))
                new = after[place[own], stage[own]]
                moves.append((own, place[own], new))
                stage[own], at[own] = new, place[own] + 1
            held = _held(n, begin, np.zeros(len(begin), np.int64), moves)
            yield from table.select(part).append_column("__entry", pa.array(held)).combine_chunks().to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, part):
            # Every block has one row that carries its stage, and the updates.
            real = table["__entry"].is_null().to_numpy()
            own, start = table.filter(pa.array(real)), table["__entry"].drop_null().to_numpy()
            walks = _Walks(group[real], _numbers(own["stage"]))
            held = _held(own.num_rows, walks.begin, start, walks.moves(start))
            current = pa.array(np.array(STAGES, dtype=object)[held], pa.string())
            yield from own.drop_columns(["__entry"]).append_column("current", current).combine_chunks().to_batches()

    asked = rows.select(*part, "seq", "stage")
    blocks = sorted_by(asked, part, ("seq",)).mapInArrow(functions, f"task_id {task}, __block bigint, after array<bigint>")
    entered = sorted_by(blocks, ["task_id"], ("__block",)).mapInArrow(entries, f"task_id {task}, __block bigint, __entry bigint")
    marked = rows.withColumn("__entry", F.lit(None).cast("bigint")).unionByName(entered, allowMissingColumns=True)
    schema = T.StructType([*rows.schema.fields, T.StructField("current", T.StringType())])
    return sorted_by(marked, part, ("seq",)).mapInArrow(walk, schema).drop("__block")


def applied_updates(updates: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Every update with what it did: ``current`` stage before it, ``verdict`` (applied,
    stale, ignored, rejected), the stage after it and the progress so far.

    ``updates`` carries ``task_id, seq, ts, stage, progress``.
    """
    rows = with_current_stage(updates, block=block)
    asked = F.coalesce("stage", F.lit(""))
    verdict = (
        F.when(F.col("current").isin(*TERMINAL), F.lit("ignored"))
        .when((asked == "") | (asked == F.col("current")), F.lit("applied"))
        .when(may_follow(F.col("current"), asked), F.lit("applied"))
        .when(stage_rank(asked) < stage_rank(F.col("current")), F.lit("stale"))
        .otherwise(F.lit("rejected"))
    )
    rows = rows.withColumn("verdict", verdict).withColumn(
        "stage_after",
        F.when((F.col("verdict") == "applied") & (asked != ""), asked).otherwise(F.col("current")),
    )
    counts = F.col("verdict").isin("applied", "stale")
    return scan(
        rows, ["task_id"], F.col("seq"), width=block,
        maxes={"progress_after": F.when(counts, F.greatest(F.coalesce("progress", F.lit(0.0)), F.lit(0.0)))},
    )


COUNTERS = ("total_chunks", "cut_completed", "tracking_completed")


def fold_status(updates: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The final status of every task after all its updates.

    Optional columns: ``message``, the counters, ``error_code``, ``error_detail``.
    """
    have = set(updates.columns)
    rows = applied_updates(updates, block=block).where("verdict in ('applied', 'stale')")

    def last_text(col: str, extra: Column = F.lit(True), cut: int | None = None) -> Column:
        text = F.col(col) if cut is None else F.substring(col, 1, cut)
        return F.max_by(text, F.when((F.coalesce(F.col(col), F.lit("")) != "") & extra, F.col("seq")))

    aggs = [
        F.max_by("stage_after", "seq").alias("stage"),
        F.max("progress_after").alias("progress"),
        F.min_by("ts", F.when(F.col("stage_after") != "queued", F.col("seq"))).alias("processing_started_at"),
        F.max_by("ts", "seq").alias("updated_at"),
    ]
    if "message" in have:
        fits = F.col("progress").isNull() | (F.col("progress") >= F.col("progress_after"))
        aggs.append(last_text("message", (F.col("verdict") == "applied") & fits).alias("message"))
    aggs += [F.greatest(F.lit(0), F.max(c)).alias(c) for c in COUNTERS if c in have]
    if "error_code" in have:
        aggs.append(last_text("error_code").alias("error_code"))
    if "error_detail" in have:
        aggs.append(last_text("error_detail", cut=2000).alias("error_detail"))
    return rows.groupBy("task_id").agg(*aggs)


def stage_progress(stage: Column, done: Column, total: Column) -> Column:
    """Per cent for a stage with ``done`` of ``total`` chunks."""
    share = F.least(done / F.greatest(total, F.lit(1)), F.lit(1.0))
    known = total > 0
    return (
        F.when(stage == "downloading", F.lit(2.0))
        .when(stage == "decoding", F.lit(5.0))
        .when(stage == "ingest", F.lit(8.0) + F.lit(22.0) * done / F.greatest(total, F.lit(1)))
        .when(stage == "cut_detection", F.when(known, F.lit(30.0) + F.lit(30.0) * share).otherwise(F.lit(30.0)))
        .when(stage == "tracking", F.when(known, F.lit(60.0) + F.lit(30.0) * share).otherwise(F.lit(60.0)))
        .when(stage == "completed", F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def progress_ticks(kind: Column, n: Column, total: Column, stage_changed: Column, every: int = 5) -> Column:
    """I4: whether the ``n``-th chunk of ``total`` writes progress."""
    regular = n % every == 0
    full = (total > 0) & (n >= total)
    return (
        F.when(kind == "ingest", (n == 1) | (n >= total) | regular)
        .when(kind == "cut", stage_changed | full | regular)
        .otherwise(full | regular)
    )


def current_status(updates: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest row of each wanted task; ``found`` is false for unknown tasks."""
    rest = [c for c in updates.columns if c not in ("task_id", "seq")]
    latest = updates.groupBy("task_id").agg(F.max_by(F.struct("seq", *rest), "seq").alias("r"))
    joined = wanted.select("task_id").join(latest, "task_id", "left")
    return joined.select("task_id", "r.*", F.col("r").isNotNull().alias("found"))


def batch_progress(status: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per archive the mean progress, finished tasks and the first unfinished one.

    ``tasks(archive_id, task_id, ord)``; the mean divides sums of exact values once.
    """
    ended = F.col("stage").isin(*TERMINAL)
    return tasks.join(status, "task_id").groupBy("archive_id").agg(
        (F.sum("progress") / F.count(F.lit(1))).alias("mean_progress"),
        F.count_if(ended).alias("finished"),
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.min_by("stage", F.when(~ended, F.col("ord"))), F.lit("completed")).alias("active_stage"),
    )


def processing_started_at(applied: DataFrame) -> DataFrame:
    """I8: time of the first update after which the task is no longer queued."""
    moved = F.when(F.col("stage_after") != "queued", F.col("seq"))
    return applied.where("verdict in ('applied', 'stale')").groupBy("task_id").agg(
        F.min_by("ts", moved).alias("processing_started_at")
    )


def stage_changes(status: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Rows whose stage differs from the task's previous row."""
    rows = scan(status, ["task_id"], F.col("seq"), width=block, previous={"__before": F.col("stage")})
    return rows.where(~F.col("stage").eqNullSafe(F.col("__before"))).drop("__before")
