"""Ordering, idempotency and delivery rules over message tables (H)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.operators.blocks import sorted_by, whole_groups
from shotspark.operators.ordered import BLOCK, TIME_BLOCK_US, scan
from shotspark.session import durable

CHUNK = ["task_id", "chunk_index"]


def publish_once(events: DataFrame, keys=tuple(CHUNK), order=("arrived_at", "event_id")) -> DataFrame:
    """H1: the first event per key; a grouped minimum, so repeats combine map-side."""
    keys, order = list(keys), list(order)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def published_counts(events: DataFrame) -> DataFrame:
    """H1: distinct published chunks per task."""
    return events.select(*CHUNK).distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("published"))


def contiguous_dispatch(cuts: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """H2: chunk ``i`` can be dispatched once ``0 .. i`` have all arrived, at the latest of
    those arrivals; chunks behind a hole stay out."""
    firsts = publish_once(cuts).select(*CHUNK, "arrived_at")
    rows = scan(
        firsts, ["task_id"], F.col("chunk_index"), width=block,
        rank="__n", maxes={"dispatched_at": F.col("arrived_at")},
    )
    return rows.where(F.col("__n") == F.col("chunk_index")).drop("__n")


# ---------------------------------------------------------------- ordered publication

#: Chunk indexes per block of the publication order.
PUBLISH_BLOCK = 4_096
_NODE = ["entry_us", "entry_id", "exit_us", "exit_id"]


class _Steps:
    """Publication as chains: where index ``i`` of a group was left, ``i + 1`` goes on at the
    first of its nodes after that.

    A node is taken at ``entry`` and leads on at ``leave``.  For a chunk both are the moment of an
    attempt; for a block they are an attempt of its first chunk and the publication of its last.
    ``leads`` tells whether a node leads on at all.  Nodes are kept by group, index and entry.
    """

    def __init__(self, group: np.ndarray, index: np.ndarray, entry: np.ndarray, leave: np.ndarray, leads: np.ndarray):
        moments = np.concatenate([entry, leave])
        rank, n = _ranks(*moments.T), len(index)
        self.order = np.lexsort((rank[:n], index, group))
        self.group, self.index, self.rank = group[self.order], index[self.order], rank[:n][self.order]
        self.entry, self.leave = entry[self.order], leave[self.order]
        new = np.ones(n, bool)
        new[1:] = (self.group[1:] != self.group[:-1]) | (self.index[1:] != self.index[:-1])
        #: Number of each (group, index), and the first node of every number.
        self.number = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        span = len(moments) + 1
        following = np.searchsorted(self.number * span + self.rank, (self.number + 1) * span + rank[n:][self.order], "right")
        at = np.minimum(following, max(0, n - 1))
        real = leads[self.order] & (following < n)
        real &= (self.group[at] == self.group) & (self.index[at] == self.index + 1) if n else real
        #: The node after each one, ``n`` after the last of a chain.
        self.following = np.where(real, following, n)

    def last(self) -> np.ndarray:
        """Where the chain from each node ends."""
        n = len(self.index)
        jump = np.where(self.following < n, self.following, np.arange(n))
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump
            jump = further

    def chains(self, starts: np.ndarray) -> np.ndarray:
        """All nodes of the chains that begin at ``starts``, in which no two of them lie."""
        n = len(self.index)
        jump, path = np.append(self.following, n), starts
        while True:
            further = jump[path]
            further = further[further < n]
            if not len(further):
                return path
            path = np.concatenate([path, further])
            jump = jump[jump]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of rows by several columns, the first one first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _moments(table: pa.Table, us: str, event: str) -> np.ndarray:
    return np.stack([pc.fill_null(table[c], 0).to_numpy().astype(np.int64) for c in (us, event)], 1)


def _attempt_steps(table: pa.Table, group: np.ndarray) -> _Steps:
    at = _moments(table, "us", "event_id")
    return _Steps(group, table["chunk_index"].to_numpy().astype(np.int64), at, at, np.ones(len(at), bool))


def ordered_publish(attempts: DataFrame, *, block: int = PUBLISH_BLOCK) -> DataFrame:
    """H3: in arrival order, an attempt below the expected chunk is a duplicate, the expected
    chunk is published and advances the sequence, and a later one is rejected.

    Needs ``task_id, chunk_index, arrived_at, event_id`` with distinct ``(arrived_at,
    event_id)`` per task; adds ``outcome``.  Negative chunks are duplicates, attempts without a
    chunk are rejected.

    Publication is a composition of functions: a chunk maps the moment its predecessor was
    published to its own first attempt after that.  A block of ``block`` consecutive chunks
    maps each attempt of its first chunk to the publication of its last, so its summary is as
    small as one chunk.  Summaries of a task are composed in order, which gives the moment each
    block is entered, and then every block replays its own attempts.  Blocks of one task
    spread over the cluster, and nothing walks attempt by attempt; what must fit into one task is
    one block with the retries of its chunks.
    """
    rows = attempts.withColumns(
        {
            "us": F.unix_micros(F.col("arrived_at").cast("timestamp")),
            # Attempts outside the sequence are spread over blocks below zero.
            "__block": F.when(F.col("chunk_index") >= 0, F.floor(F.col("chunk_index") / block).cast("bigint"))
            .otherwise(-1 - F.pmod(F.xxhash64("event_id"), F.lit(1024))),
        }
    )
    task, part = rows.schema["task_id"].dataType.simpleString(), ["task_id", "__block"]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, part):
            steps = _attempt_steps(table, group)
            first = np.flatnonzero(steps.index % block == 0)
            end = steps.last()[first]
            whole = steps.index[end] % block == block - 1
            columns = [*steps.entry[first].T, *steps.leave[end].T]
            values = [pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, (None, None, ~whole, ~whole), strict=True)]
            keys = table.select(part).take(pa.array(steps.order[first])).combine_chunks()
            yield from pa.table([*keys.columns, *values], names=[*part, *_NODE]).to_batches()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["task_id"]):
            leads = table["exit_us"].is_valid().to_numpy()
            steps = _Steps(
                group, table["__block"].to_numpy().astype(np.int64), _moments(table, "entry_us", "entry_id"),
                _moments(table, "exit_us", "exit_id"), leads,
            )
            path = steps.chains(steps.first[steps.index[steps.first] == 0])
            task_ids = table["task_id"].take(pa.array(steps.order[path])).combine_chunks()
            moments = [pa.array(c, pa.int64()) for c in steps.entry[path].T]
            yield from pa.table(
                [task_ids, pa.array(steps.index[path], pa.int64()), *moments], names=[*part, "us", "event_id"]
            ).to_batches()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, part):
            entered = table["__entered"].to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
            own = table.filter(pa.array(~entered))
            outcome = np.full(own.num_rows, "rejected", dtype=object)
            chunk = pc.fill_null(own["chunk_index"], np.iinfo(np.int64).max).to_numpy()
            outcome[chunk < 0] = "duplicate"
            inside = np.flatnonzero(own["__block"].to_numpy() >= 0)
            steps = _attempt_steps(own.take(pa.array(inside)), group[~entered][inside])
            # Entries are attempts of a block's first chunk: look them up among those.
            moments = _moments(table.filter(pa.array(entered)), "us", "event_id")
            known = _ranks(
                np.concatenate([steps.group, group[entered]]), *np.concatenate([steps.entry, moments]).T
            )
            place = dict(zip(known[: len(steps.index)].tolist(), range(len(steps.index)), strict=True))
            path = steps.chains(np.array([place[r] for r in known[len(steps.index) :].tolist()], np.int64))
            # Publication points of chunks, beyond all attempts where there is none.
            point = np.full(len(steps.first), np.iinfo(np.int64).max)
            point[steps.number[path]] = steps.rank[path]
            due = point[steps.number]
            outcome[inside[steps.order]] = np.where(steps.rank == due, "published", np.where(steps.rank > due, "duplicate", "rejected"))
            done = own.drop_columns(["__entered"]).append_column("outcome", pa.array(outcome, pa.string()))
            yield from done.combine_chunks().to_batches()

    chunked = rows.where("__block >= 0").select(*part, "chunk_index", "us", "event_id")
    node = ", ".join(f"{c} bigint" for c in _NODE)
    blocks = sorted_by(chunked, part).mapInArrow(summaries, f"task_id {task}, __block bigint, {node}")
    entered = sorted_by(blocks, ["task_id"]).mapInArrow(entries, f"task_id {task}, __block bigint, us bigint, event_id bigint")
    marked = rows.withColumn("__entered", F.lit(False)).unionByName(
        entered.withColumn("__entered", F.lit(True)), allowMissingColumns=True
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType())])
    return sorted_by(marked, part).mapInArrow(replay, schema).drop("us", "__block")


# ---------------------------------------------------------------- gates and completeness


def enrich_jobs(cuts: DataFrame, sources: DataFrame) -> DataFrame:
    """H4: cut results with their task's label selection, marked as verified."""
    return cuts.join(sources.select("task_id", "tracking_classes"), "task_id").withColumn("cut_verified", F.lit(True))


def reject_unverified(tracking: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H5: tracking results with a stored cut result, and those without."""
    known = cuts.select(*CHUNK)
    return tracking.join(known, CHUNK, "left_semi"), tracking.join(known, CHUNK, "left_anti")


def completed_tasks(tracking: DataFrame, tasks: DataFrame) -> DataFrame:
    """H6: tasks whose distinct tracked chunks reach their positive total."""
    done = tracking.select(*CHUNK).distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("completed"))
    return done.join(tasks.select("task_id", "total_chunks"), "task_id").where(
        "total_chunks > 0 and completed >= total_chunks"
    )


def ingest_complete(published: DataFrame, tasks: DataFrame) -> DataFrame:
    """H7: whether every planned chunk was published, else how far it got."""
    counts = published_counts(published)
    n = F.coalesce("published", F.lit(0)).cast("bigint")
    return tasks.select("task_id", "total_chunks").join(counts, "task_id", "left").select(
        "task_id", "total_chunks", n.alias("published"),
        (n >= F.col("total_chunks")).alias("complete"),
        F.when(n < F.col("total_chunks"), F.concat_ws("/", n.cast("string"), F.col("total_chunks").cast("string"))).alias("shortfall"),
    )


def partition_by_task(messages: DataFrame) -> DataFrame:
    """H8: messages of a task in order and together; messages without a task on their own.

    Ranges over ``(task, order)`` keep a task contiguous and sorted like a hash partition
    would, but a task too large for one partition goes on in the next.
    """
    key = F.coalesce("task_id", F.concat(F.lit("event:"), F.col("event_id").cast("string")))
    keyed = messages.withColumn("partition_key", key)
    return keyed.repartitionByRange("partition_key", "event_id").sortWithinPartitions("partition_key", "event_id")


def route_failures(attempts: DataFrame, max_attempts: int = 3, *, block: int = BLOCK) -> DataFrame:
    """Where each failing message ends.

    ``attempts(message_id, attempt_no, kind, worker, error)`` with ``kind`` terminal,
    transient or other.  Terminal failures are dead letters at once; transient ones never
    count; the third other failure is a dead letter and fails the task.
    """
    counted = scan(
        attempts, ["message_id"], F.col("attempt_no"), width=block,
        sums={"failures": F.when(F.col("kind") == "other", 1).otherwise(0)},
    )
    ends = (F.col("kind") == "terminal") | ((F.col("kind") == "other") & (F.col("failures") >= max_attempts))
    row = F.struct("attempt_no", "kind", "worker", F.substring("error", 1, 2000).alias("error"))
    return counted.groupBy("message_id").agg(
        F.min(F.when(ends, row)).alias("r"),
        F.max("attempt_no").alias("last_attempt"),
    ).select(
        "message_id",
        F.when(F.col("r").isNull(), F.lit("pending")).otherwise(F.lit("dead_letter")).alias("route"),
        F.coalesce("r.attempt_no", "last_attempt").alias("attempt_no"),
        F.col("r.error").alias("error"),
        F.when(
            F.col("r.kind") == "other", F.concat(F.replace("r.worker", F.lit("-"), F.lit("_")), F.lit("_failed"))
        ).alias("task_error_code"),
    )


def stalled_tasks(progress: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """Non-terminal tasks without durable progress for at least ``seconds``.

    ``progress(task_id, ts, stage)``; the newest row gives the stage.
    """
    latest = progress.groupBy("task_id").agg(F.max(F.struct("ts", "seq", "stage")).alias("r"))
    idle = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("r.ts").cast("timestamp"))
    return latest.select("task_id", F.col("r.stage").alias("stage"), idle.alias("idle_us")).where(
        ~F.col("stage").isin("completed", "failed") & (F.col("idle_us") >= seconds * 1_000_000)
    )


def in_flight(
    published: DataFrame, completed: DataFrame, per_task: int = 2, overall: int = 2, *, width: int = TIME_BLOCK_US
) -> DataFrame:
    """Chunks in flight after every event, per task and overall, with limit flags.

    Both inputs are ``task_id, us, event_id``.  With more than one active task a task may
    hold a single chunk.
    """
    events = published.select("task_id", "us", "event_id", F.lit(1).alias("delta")).unionByName(
        completed.select("task_id", "us", "event_id", F.lit(-1).alias("delta"))
    )
    order = ["delta", "event_id"]
    # Written once, because the scan over all tasks reads its input twice.
    mine = durable(scan(events, ["task_id"], F.col("us"), order, width=width, sums={"task_in_flight": F.col("delta")}))
    turn = (
        F.when((F.col("delta") == 1) & (F.col("task_in_flight") == 1), 1)
        .when((F.col("delta") == -1) & (F.col("task_in_flight") == 0), -1)
        .otherwise(0)
    )
    both = scan(
        mine.withColumns({"turn": turn, "__all": F.lit(0)}), ["__all"], F.col("us"), ["delta", "event_id", "task_id"],
        width=width, sums={"total_in_flight": F.col("delta"), "active_tasks": F.col("turn")},
    )
    allowed = F.when(F.col("active_tasks") > 1, 1).otherwise(per_task)
    return both.drop("turn", "__all").withColumns(
        {"over_task": F.col("task_in_flight") > allowed, "over_total": F.col("total_in_flight") > overall}
    )


def retain(
    entries: DataFrame, as_of: Column, ttl_seconds: int = 7 * 86_400, maxlen: int = 50_000, *, width: int = TIME_BLOCK_US
) -> DataFrame:
    """Drop entries past their age, keep the newest ``maxlen`` of each stream.

    The rank counts back from ``as_of`` in time blocks, so a busy stream spreads out
    however large ``maxlen`` is.
    """
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = entries.withColumns({"__age": age, "__back": -F.col("event_id")}).where(
        F.col("__age") < ttl_seconds * 1_000_000
    )
    ranked = scan(fresh, ["stream"], F.col("__age"), ["__back"], width=width, rank="__rank")
    return ranked.where(F.col("__rank") < maxlen).drop("__age", "__back", "__rank")


def skip_terminal(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Jobs of tasks that neither ended nor finished ingest."""
    closed = status.where("stage in ('completed', 'failed') or ingest_complete")
    return jobs.join(closed.select("task_id"), "task_id", "left_anti")


def unacked_stale(deliveries: DataFrame, acks: DataFrame, as_of: Column, idle_seconds: int = 60) -> DataFrame:
    """Delivered, never acknowledged, and untouched for ``idle_seconds``."""
    touched = deliveries.groupBy("message_id").agg(F.max("touched_at").alias("touched_at"))
    idle = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("touched_at").cast("timestamp"))
    return (
        touched.join(acks.select("message_id"), "message_id", "left_anti")
        .withColumn("idle_us", idle)
        .where(F.col("idle_us") >= idle_seconds * 1_000_000)
        .select("message_id", "idle_us")
    )
