"""Structured Streaming forms of the order-dependent operators.

State is keyed by task, video or series and kept in the RocksDB state store, so executors
may be lost at any time.  Sessions need ``shotspark.session.STREAMING_SETTINGS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotspark.operators.metrics import ALERT_RULES, AlertRule, watched
from shotspark.streaming.folds import ChunkRanges, Pending, Status, own_gradual_step, publish_step, status_step


@dataclass(frozen=True)
class Expiry:
    """How long a key's state is kept after its last row: event time ``column``, how late rows may be, seconds."""

    column: str
    delay: str
    seconds: int


def _run(
    df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, expiry: Expiry | None = None, time_mode: str = "None"
) -> DataFrame:
    """``processor`` over ``df``; with ``expiry`` it forgets keys that stayed silent."""
    if expiry is not None:
        df = df.withWatermark(expiry.column, expiry.delay)
        processor, time_mode = _Forgetting(processor, expiry), "EventTime"
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode
    )


class _Forgetting(StatefulProcessor):
    """Another processor whose states are cleared once event time has passed a key's last row long enough.

    One timer per key is enough: it moves with every later row.
    """

    def __init__(self, inner: StatefulProcessor, expiry: Expiry) -> None:
        self.inner, self.expiry = inner, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms BIGINT")
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        last = max(b[self.expiry.column].max() for b in batches)
        due = int(pd.Timestamp(last).timestamp() * 1000) + 1000 * self.expiry.seconds
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or due > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from self.inner.handleInputRows(key, iter(batches), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.inner.forget()
        self.due.clear()
        return iter(())

    def close(self) -> None:
        self.inner.close()


def _event_time(expiry: Expiry | None) -> list[str]:
    return [] if expiry is None else [expiry.column]


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The new rows of one key in this micro-batch, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


# ---------------------------------------------------------------- H1


def publish_once_stream(events: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """H1: each key once.  With ``watermark=(column, delay)`` state is dropped after the
    delay and repeats are recognised within it; without, state is kept for ever."""
    if watermark is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- H2


class _Dispatch(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "next BIGINT, latest BIGINT")
        self.waiting = handle.getMapState("waiting", "chunk_index BIGINT", "arrived_us BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index, latest = self.progress.get() if self.progress.exists() else (0, 0)
        new = _rows(rows, ["arrived_us"])
        for chunk, us in zip(new["chunk_index"].tolist(), new["arrived_us"].tolist()):
            if chunk >= index and not self.waiting.containsKey((chunk,)):
                self.waiting.updateValue((chunk,), (us,))
        ready = []
        while self.waiting.containsKey((index,)):
            us = self.waiting.getValue((index,))[0]
            self.waiting.removeKey((index,))
            latest = max(latest, us)
            ready.append((key[0], index, us, latest))
            index += 1
        self.progress.update((index, latest))
        yield pd.DataFrame(ready, columns=["task_id", "chunk_index", "arrived_us", "dispatched_us"])

    def forget(self) -> None:
        self.progress.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def contiguous_dispatch_stream(arrivals: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """H2: ``task_id, chunk_index, arrived_us``; a chunk waits until all before it came.

    With ``expiry`` a task that stays silent is forgotten with all chunks that still wait.
    """
    schema = "task_id BIGINT, chunk_index BIGINT, arrived_us BIGINT, dispatched_us BIGINT"
    rows = arrivals.select("task_id", "chunk_index", "arrived_us", *_event_time(expiry))
    return _run(rows, ["task_id"], _Dispatch(), schema, expiry)


# ---------------------------------------------------------------- H3


class _Publish(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "n BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected = self.expected.get()[0] if self.expected.exists() else 0
        new = _rows(rows, ["us", "event_id"])
        out = []
        for chunk, event in zip(new["chunk_index"].tolist(), new["event_id"].tolist()):
            expected, outcome = publish_step(expected, chunk)
            out.append((key[0], chunk, event, outcome))
        self.expected.update((expected,))
        yield pd.DataFrame(out, columns=["task_id", "chunk_index", "event_id", "outcome"])

    def forget(self) -> None:
        self.expected.clear()

    def close(self) -> None:
        pass


def ordered_publish_stream(attempts: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """H3: ``task_id, chunk_index, us, event_id``; the outcome of every attempt."""
    schema = "task_id BIGINT, chunk_index BIGINT, event_id BIGINT, outcome STRING"
    rows = attempts.select("task_id", "chunk_index", "us", "event_id", *_event_time(expiry))
    return _run(rows, ["task_id"], _Publish(), schema, expiry)


# ---------------------------------------------------------------- I2

_STATUS = (
    "stage STRING, progress DOUBLE, message STRING, total_chunks BIGINT, cut_completed BIGINT, "
    "tracking_completed BIGINT, error_code STRING, error_detail STRING, processing_started_us BIGINT, updated_us BIGINT"
)
_FIELDS = [part.split()[0] for part in _STATUS.split(", ")]
_UPDATE = ("message", "total_chunks", "cut_completed", "tracking_completed", "error_code", "error_detail")


class _FoldStatus(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", _STATUS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = Status(*self.status.get()) if self.status.exists() else Status()
        new = _rows(rows, ["seq"])
        new = new.astype(object).where(new.notna(), None)
        for update in new.to_dict("records"):
            status_step(status, update)
        values = tuple(getattr(status, f) for f in _FIELDS)
        self.status.update(values)
        last = int(new["seq"].iloc[-1])
        yield pd.DataFrame([(key[0], last, *values)], columns=["task_id", "seq", *_FIELDS])

    def forget(self) -> None:
        self.status.clear()

    def close(self) -> None:
        pass


def fold_status_stream(updates: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """The folded status of every task touched by a micro-batch.

    ``updates`` as for the batch fold, with ``ts``; absent optional columns count as NULL.
    The newest row per task (highest ``seq``) is its current status.
    """
    have = set(updates.columns)
    kinds = dict(p.split() for p in _STATUS.split(", "))
    extra = [F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in _UPDATE]
    rows = updates.select(
        "task_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "stage", "progress", *extra,
        *_event_time(expiry),
    )
    return _run(rows, ["task_id"], _FoldStatus(), f"task_id BIGINT, seq BIGINT, {_STATUS}", expiry)


# ---------------------------------------------------------------- F3


class _OwnGradual(StatefulProcessor):
    """Chunks may arrive in any order; a chunk waits until its predecessors are done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next BIGINT, start BIGINT, confidence DOUBLE")
        self.waiting = handle.getMapState(
            "waiting", "chunk_index BIGINT",
            "context_end BIGINT, valid_start BIGINT, valid_end BIGINT, is_last BOOLEAN, "
            "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, confidences ARRAY<DOUBLE>",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Pending(*self.state.get()) if self.state.exists() else Pending()
        for row in _rows(rows, ["chunk_index"]).itertuples(index=False):
            if row.chunk_index >= state.next_chunk:
                self.waiting.updateValue(
                    (int(row.chunk_index),),
                    (
                        int(row.context_end), int(row.valid_start), int(row.valid_end), bool(row.is_last),
                        [int(x) for x in row.starts], [int(x) for x in row.ends], [float(x) for x in row.confidences],
                    ),
                )
        out = []
        while self.waiting.containsKey((state.next_chunk,)):
            index = state.next_chunk
            end, first, last, is_last, starts, ends, confidences = self.waiting.getValue((index,))
            self.waiting.removeKey((index,))
            chunk = ChunkRanges(end, first, last, is_last, list(zip(starts, ends, confidences)))
            out += [(key[0], index, *g) for g in own_gradual_step(state, chunk)]
        self.state.update((state.next_chunk, state.start, state.confidence))
        yield pd.DataFrame(out, columns=["video_id", "chunk_index", "start_frame", "end_frame", "confidence"])

    def forget(self) -> None:
        self.state.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def own_gradual_stream(chunk_messages: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """one message per chunk: its ranges and ``graduals ARRAY<STRUCT<start_frame,
    end_frame, confidence>>`` in video coordinates.

    With ``expiry`` a chunk that never comes holds its video only until it has been silent
    that long; what waited behind it is dropped.
    """
    rows = chunk_messages.select(
        "video_id", "chunk_index", "context_end", "valid_start", "valid_end", "is_last",
        F.col("graduals.start_frame").alias("starts"), F.col("graduals.end_frame").alias("ends"),
        F.col("graduals.confidence").alias("confidences"), *_event_time(expiry),
    )
    schema = "video_id BIGINT, chunk_index BIGINT, start_frame BIGINT, end_frame BIGINT, confidence DOUBLE"
    return _run(rows, ["video_id"], _OwnGradual(), schema, expiry)


# ---------------------------------------------------------------- H11


class _Stalled(StatefulProcessor):
    def __init__(self, seconds: int) -> None:
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us BIGINT, stage STRING, timer BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, ["us", "seq"])
        us, stage, timer = self.last.get() if self.last.exists() else (None, "queued", None)
        old_timer, stalls = timer, []
        for now, next_stage in zip(new["us"].tolist(), new["stage"].tolist()):
            if us is not None and now < us:
                continue
            # A stall may end before the watermark reports it: the gap itself is the proof.
            if timer is not None and now // 1000 >= timer:
                stalls.append((key[0], stage, us))
            us, stage = now, next_stage
            timer = None if stage in ("completed", "failed") else us // 1000 + self.ms
        if timer != old_timer:
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.last.update((us, stage, timer))
        yield pd.DataFrame(stalls, columns=["task_id", "stage", "last_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, stage, _ = self.last.get()
        self.last.update((us, stage, None))
        yield pd.DataFrame([(key[0], stage, us)], columns=["task_id", "stage", "last_us"])

    def close(self) -> None:
        pass


def stalled_tasks_stream(progress: DataFrame, seconds: int = 120, delay: str = "10 seconds") -> DataFrame:
    """A task once per stall, when event time passes its last progress by ``seconds``.

    ``progress(task_id, seq, ts, stage)`` with ``ts`` a TIMESTAMP.
    """
    rows = progress.withWatermark("ts", delay).select(
        "task_id", "seq", "ts", F.unix_micros("ts").alias("us"), "stage"
    )
    return _run(rows, ["task_id"], _Stalled(seconds), "task_id BIGINT, stage STRING, last_us BIGINT", time_mode="EventTime")


# ---------------------------------------------------------------- L1


class _Increments(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, ["us", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        grown = []
        for value in new["value"].tolist():
            grown.append(0 if before is None else value if value < before else value - before)
            before = value
        self.last.update((before,))
        yield pd.DataFrame(
            {"series": key[0], "us": new["us"], "event_id": new["event_id"], "increase": grown}
        )

    def forget(self) -> None:
        self.last.clear()

    def close(self) -> None:
        pass


def counter_increments_stream(samples: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """L1: the reset-aware increase of each sample of ``series, us, event_id, value``; sum
    them over any window downstream.  A series that comes back after its ``expiry`` begins anew."""
    schema = "series STRING, us BIGINT, event_id BIGINT, increase BIGINT"
    rows = samples.select("series", "us", "event_id", "value", *_event_time(expiry))
    return _run(rows, ["series"], _Increments(), schema, expiry)


# ---------------------------------------------------------------- rows in event-time order


class _InOrder(StatefulProcessor):
    """Rows of a key wait until event time has passed them and are then handled in order.

    However rows are spread over micro-batches, those that come within the delay are
    seen in the order of ``(us, event_id)``.  Subclasses name their columns and give ``step``.
    """

    WAITING: str
    OUT: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.timer = handle.getValueState("timer", "ms BIGINT")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in self.WAITING.split(", ")]
        new = pd.concat([b[columns] for b in rows], ignore_index=True).astype(object)
        new = new.where(new.notna(), None)
        yield from self._advance(key, [*self.waiting.get(), *new.itertuples(index=False, name=None)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._advance(key, list(self.waiting.get()), timerValues)

    def _advance(self, key, rows: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in rows), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] // 1000 < passed]
        later = rows[len(ready) :]
        out = [row for r in ready for row in self.step(key, r)]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        due = self.due(later[0][0] // 1000 + 1 if later else None)
        old = self.timer.get()[0] if self.timer.exists() else None
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
                self.timer.clear()
            if due is not None:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        yield pd.DataFrame([(*key, *row) for row in out], columns=self.OUT)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def step(self, key, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def due(self, waiting: int | None) -> int | None:
        """When to be called next, given when the first waiting row is passed."""
        return waiting

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- L5


class _Alerts(_InOrder):
    WAITING = "us BIGINT, event_id BIGINT, met BOOLEAN"
    OUT = ["alert", "severity", "seconds", "state", "since_us", "until_us"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "since BIGINT, until BIGINT, firing BOOLEAN")

    def step(self, key, row: tuple) -> list[tuple]:
        us, _, met = row
        since, until, firing = self.held.get() if self.held.exists() else (None, None, False)
        if not met:
            self.held.clear()
            return [] if since is None else [("resolved" if firing else "cleared", since, until)]
        out = [("pending", us, us)] if since is None else []
        since = us if since is None else since
        if not firing and us - since >= 1_000_000 * key[2]:
            out.append(("firing", since, us))
            firing = True
        self.held.update((since, us, firing))
        return out


def evaluate_alerts_stream(samples: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES, delay: str = "30 seconds") -> DataFrame:
    """What each rule does over ``samples(series, ts, event_id, value)``, all rules in one pass.

    A rule is ``pending`` from the first sample that meets it, ``firing`` once the samples
    have met it for its time, and ``resolved`` by the first that does not (``cleared`` if it
    never fired).  Samples wait for ``delay`` of event time, and are then taken in order, so late and
    disordered ones within it change nothing.  ``since_us`` to ``until_us`` of a resolved
    row is the period that the batch form gives.
    """
    rows = watched(samples.withWatermark("ts", delay), rules).select(
        "alert", "severity", F.col("seconds").cast("bigint").alias("seconds"), "ts", F.unix_micros("ts").alias("us"), "event_id", "met"
    )
    schema = "alert STRING, severity STRING, seconds BIGINT, state STRING, since_us BIGINT, until_us BIGINT"
    return _run(rows, ["alert", "severity", "seconds"], _Alerts(), schema, time_mode="EventTime").drop("seconds")


# ---------------------------------------------------------------- H5, H6


def reject_unverified_stream(
    tracking: DataFrame, cuts: DataFrame, wait: str = "60 seconds", keep: str = "7 days", delay: str = "10 seconds"
) -> DataFrame:
    """H5: every tracking result of ``task_id, chunk_index, ts`` once, with ``accepted``.

    A result is accepted when a cut result of its chunk came at most ``keep`` before it or
    ``wait`` after it, whichever of both streams brings its row first; it is refused when
    event time has passed the wait.  Repeats of a chunk count once in either stream, and cut
    results leave the state after ``keep``.
    """
    known = (
        cuts.select(F.col("task_id").alias("cut_task"), F.col("chunk_index").alias("cut_chunk"), F.col("ts").alias("cut_ts"))
        .withWatermark("cut_ts", delay)
        .dropDuplicatesWithinWatermark(["cut_task", "cut_chunk"])
    )
    results = tracking.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id", "chunk_index"])
    fits = F.expr(
        f"cut_task = task_id AND cut_chunk = chunk_index AND cut_ts >= ts - INTERVAL {keep} AND cut_ts <= ts + INTERVAL {wait}"
    )
    joined = results.join(known, fits, "left_outer")
    return joined.select(*tracking.columns, F.col("cut_task").isNotNull().alias("accepted"))


class _Completed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "chunk_index BIGINT", "us BIGINT")
        self.total = handle.getValueState("total", "total BIGINT, n BIGINT, told BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n, told = self.total.get() if self.total.exists() else (0, 0, False)
        for batch in rows:
            for chunk, planned in zip(batch["chunk_index"], batch["total_chunks"], strict=True):
                if pd.notna(planned):
                    total = max(total, int(planned))
                if pd.notna(chunk) and not told and not self.done.containsKey((int(chunk),)):
                    self.done.updateValue((int(chunk),), (0,))
                    n += 1
        new = not told and 0 < total <= n
        if new:
            # The chunks are not needed any more, only that the task has been told.
            self.done.clear()
        self.total.update((total, n, told or new))
        yield pd.DataFrame([(key[0], total, n)] if new else [], columns=["task_id", "total_chunks", "completed"])

    def forget(self) -> None:
        self.done.clear()
        self.total.clear()

    def close(self) -> None:
        pass


def completed_tasks_stream(tracking: DataFrame, tasks: DataFrame, expiry: Expiry | None = None) -> DataFrame:
    """H6: each task once, when its distinct tracked chunks reach its positive total.

    ``tracking(task_id, chunk_index)`` and ``tasks(task_id, total_chunks)`` are both streams,
    in any order; with ``expiry`` both carry its column.  ``completed`` is the count at that time.
    """
    time = _event_time(expiry)
    nothing = F.lit(None).cast("bigint")
    rows = tracking.select("task_id", "chunk_index", nothing.alias("total_chunks"), *time).unionByName(
        tasks.select("task_id", nothing.alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), *time)
    )
    return _run(rows, ["task_id"], _Completed(), "task_id BIGINT, total_chunks BIGINT, completed BIGINT", expiry)


# ---------------------------------------------------------------- H13


class _Retain(StatefulProcessor):
    def __init__(self, seconds: int, maxlen: int) -> None:
        self.ms, self.maxlen = 1000 * seconds, maxlen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us BIGINT, event_id BIGINT")
        self.timer = handle.getValueState("timer", "ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["us"].tolist(), b["event_id"].tolist(), strict=True)]
        yield from self._trim(key, [*self.kept.get(), *new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._trim(key, self.kept.get(), timerValues)

    def _trim(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - self.ms
        rows = sorted(tuple(r) for r in rows)
        old = [r for r in rows if r[0] // 1000 < passed]
        rest = rows[len(old) :]
        cut = max(0, len(rest) - self.maxlen)
        kept = rest[cut:]
        if kept:
            self.kept.put(kept)
        else:
            self.kept.clear()
        due = kept[0][0] // 1000 + self.ms + 1 if kept else None
        last = self.timer.get()[0] if self.timer.exists() else None
        if due != last:
            if last is not None:
                self.handle.deleteTimer(last)
                self.timer.clear()
            if due is not None:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        gone = [(key[0], e, why) for part, why in ((old, "age"), (rest[:cut], "length")) for _, e in part]
        yield pd.DataFrame(gone, columns=["stream", "event_id", "reason"])

    def close(self) -> None:
        pass


def retain_stream(entries: DataFrame, ttl_seconds: int = 7 * 86_400, maxlen: int = 50_000, delay: str = "10 seconds") -> DataFrame:
    """Every entry of ``stream, ts, event_id`` once when it leaves its stream, with the ``reason``.

    An entry goes when event time has passed its age, or when ``maxlen`` newer ones have
    come.  What has not been named is retained; a stream's state holds at most ``maxlen``
    entries and empties when nothing comes any more.
    """
    rows = entries.withWatermark("ts", delay).select("stream", "ts", F.unix_micros("ts").alias("us"), "event_id")
    schema = "stream STRING, event_id BIGINT, reason STRING"
    return _run(rows, ["stream"], _Retain(ttl_seconds, maxlen), schema, time_mode="EventTime")
