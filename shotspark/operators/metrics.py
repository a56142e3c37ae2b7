"""Windows over metric samples: rates, ratios, alerts and histograms (L)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotspark.operators.ordered import TIME_BLOCK_US, islands, scan, with_halo

SECOND_US = 1_000_000


def _increments(samples: DataFrame, labels: list[str], width: int) -> DataFrame:
    """``__inc``: the growth of each counter since its sample before, aware of resets."""
    rows = scan(samples, labels, F.col("us"), ["event_id"], width=width, previous={"__prev": F.col("value")})
    grown = F.when(F.col("__prev").isNull(), F.lit(0)).when(
        F.col("value") < F.col("__prev"), F.col("value")
    ).otherwise(F.col("value") - F.col("__prev"))
    return rows.withColumn("__inc", grown).drop("__prev")


def _trailing_sum(rows: DataFrame, labels: list[str], seconds: int, width: int) -> DataFrame:
    reach = seconds * SECOND_US
    w = Window.partitionBy(*labels, "block").orderBy("us").rangeBetween(-(reach - 1), 0)
    return (
        with_halo(rows, F.col("us"), reach, max(width, reach), trailing=True)
        .withColumn("increase", F.sum("__inc").over(w))
        .where("is_home")
        .drop("__inc", "block", "is_home")
    )


def counter_increase(samples: DataFrame, labels: Sequence[str], seconds: int = 300, *, width: int = TIME_BLOCK_US) -> DataFrame:
    """L1: increase of each counter over the trailing ``seconds`` at every sample.

    ``samples(*labels, us, event_id, value)``.  A drop is a reset, after which the new value
    counts in full.  The window ``(us - seconds, us]`` needs the block before only, so rows
    near a block's end are copied on and no series is gathered.
    """
    labels = list(labels)
    return _trailing_sum(_increments(samples, labels, width), labels, seconds, width)


def counter_rate(samples: DataFrame, labels: Sequence[str], seconds: int = 300, *, width: int = TIME_BLOCK_US) -> DataFrame:
    """L2: :func:`counter_increase` per second."""
    rows = counter_increase(samples, labels, seconds, width=width)
    return rows.withColumn("rate", F.col("increase") / F.lit(float(seconds)))


def latest_sum(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """L3: sum of the latest value of every label set."""
    latest = samples.groupBy(*labels).agg(F.max_by("value", F.struct("us", "event_id")).alias("value"))
    return latest.agg(F.sum("value").alias("total"))


def used_ratio(free: DataFrame, total: DataFrame, keys: Sequence[str], *, of_sum: bool = False) -> DataFrame:
    """L4: ``1 - free / total``; with ``of_sum`` the inputs are used and free and the result
    is ``used / (used + free)``."""
    rows = free.select(*keys, F.col("value").alias("a")).join(total.select(*keys, F.col("value").alias("b")), list(keys))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = F.try_divide(a, a + b) if of_sum else F.lit(1.0) - F.try_divide(a, b)
    return rows.select(*keys, ratio.alias("ratio"))


@dataclass(frozen=True)
class AlertRule:
    """A predicate over ``series`` that must hold for ``seconds``."""

    name: str
    series: str
    predicate: str
    seconds: int
    severity: str


# The alert rules.
ALERT_RULES = (
    AlertRule("BackendUnavailable", "backend_up", "value = 0", 60, "critical"),
    AlertRule("RedisUnavailable", "redis_up", "value = 0", 60, "critical"),
    AlertRule("HostMemoryPressure", "memory_used_ratio", "value > 0.90", 300, "warning"),
    AlertRule("GPUHighTemperature", "gpu_temperature", "value > 85", 120, "warning"),
    AlertRule("GPUMemoryPressure", "gpu_memory_used_ratio", "value > 0.92", 180, "warning"),
    AlertRule("SharedMemoryPressure", "shm_used_ratio", "value > 0.85", 180, "warning"),
    AlertRule("PipelineWorkerErrors", "worker_errors_increase", "value > 0", 60, "warning"),
)


def alert_for(
    series: DataFrame, keys: Sequence[str], predicate: Column, seconds: int | Column, *, width: int = TIME_BLOCK_US
) -> DataFrame:
    """Periods in which every sample met ``predicate`` for at least ``seconds``.

    ``series(*keys, us, event_id, ...)``; ``seconds`` may depend on the keys.  Samples are
    numbered, and unbroken numbers that meet the predicate form the periods.
    """
    keys = list(keys)
    numbered = scan(series, keys, F.col("us"), ["event_id"], width=width, rank="__n")
    held = islands(
        numbered.where(predicate), keys, F.col("__n"), F.col("__n"),
        maxes={"until_us": F.col("us"), "__neg": -F.col("us")}, sums={"samples": F.lit(1)},
    )
    return held.select(
        *keys, (-F.col("__neg")).alias("since_us"), "until_us", "samples"
    ).where(F.col("until_us") - F.col("since_us") >= F.lit(seconds).cast("bigint") * SECOND_US)


def watched(samples: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    """Every sample once per rule on its series, with ``alert, severity, seconds, met``."""
    by_series: dict[str, list[Column]] = {}
    for rule in rules:
        met = F.coalesce(F.expr(rule.predicate), F.lit(False))
        by_series.setdefault(rule.series, []).append(
            F.struct(
                F.lit(rule.name).alias("alert"), F.lit(rule.severity).alias("severity"),
                F.lit(rule.seconds).alias("seconds"), met.alias("met"),
            )
        )
    own = None
    for series, found in by_series.items():
        test = F.col("series") == series
        own = F.when(test, F.array(*found)) if own is None else own.when(test, F.array(*found))
    return samples.where(F.col("series").isin(*by_series)).select("*", F.inline(own))


def evaluate_alerts(samples: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES, keys: Sequence[str] = ()) -> DataFrame:
    """All rules over ``samples(series, *keys, us, event_id, value)`` in one pass.

    Each rule holds for every combination of ``keys`` (instances, devices) by itself.
    """
    held = alert_for(watched(samples, rules), ["alert", "severity", "seconds", *keys], F.col("met"), F.col("seconds"))
    return held.select("alert", "severity", *keys, "since_us", "until_us")


# The gauges and counters that the rules read, and the series they become.
GAUGE_SERIES = {
    ("up", "backend"): "backend_up",
    ("up", "redis"): "redis_up",
    ("DCGM_FI_DEV_GPU_TEMP", None): "gpu_temperature",
}
RATIO_SERIES = {
    "memory_used_ratio": ("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes", None, False),
    "shm_used_ratio": ("node_filesystem_avail_bytes", "node_filesystem_size_bytes", "/dev/shm", False),
    "gpu_memory_used_ratio": ("DCGM_FI_DEV_FB_USED", "DCGM_FI_DEV_FB_FREE", None, True),
}
ERROR_COUNTER, ERROR_SERIES = "cv_worker_errors_total", "worker_errors_increase"


def alert_series(raw: DataFrame, seconds: int = 300, *, width: int = TIME_BLOCK_US) -> DataFrame:
    """The series of :data:`ALERT_RULES` from scraped metrics.

    ``raw(metric, job, instance, us, event_id, value DOUBLE)``: ``job`` is the label that tells
    targets, mount points or workers apart.  Gauges pass, pairs of gauges scraped at the same
    moment become ratios, and increases of the error counters over ``seconds`` are summed
    over all workers at every scrape.  Returns ``series, instance, us, event_id, value``.
    """
    gauge = None
    for (metric, job), series in GAUGE_SERIES.items():
        test = (F.col("metric") == metric) & (F.lit(True) if job is None else F.col("job") == job)
        gauge = F.when(test, F.lit(series)) if gauge is None else gauge.when(test, F.lit(series))
    out = raw.select(gauge.alias("series"), "instance", "us", "event_id", "value").where("series is not null")
    side, series, of_sum = None, None, None
    for name, (first, second, job, summed) in RATIO_SERIES.items():
        here = F.lit(True) if job is None else F.col("job") == job
        for number, metric in enumerate((first, second)):
            test = here & (F.col("metric") == metric)
            add = lambda c, v: F.when(test, F.lit(v)) if c is None else c.when(test, F.lit(v))  # noqa: B023, E731
            side, series, of_sum = add(side, number), add(series, name), add(of_sum, summed)
    # Both gauges of a ratio meet by moment and instance: one grouped pass instead of a join each.
    pairs = raw.select(side.alias("side"), series.alias("series"), of_sum.alias("of_sum"), "instance", "us", "event_id", "value")
    value = lambda n: F.max_by("value", F.when(F.col("side") == n, F.col("event_id")))
    ratios = (
        pairs.where("series is not null").groupBy("series", "of_sum", "instance", "us")
        .agg(value(0).alias("a"), value(1).alias("b"), F.max("event_id").alias("event_id"))
        .withColumn("value", F.when(F.col("of_sum"), F.try_divide("a", F.col("a") + F.col("b"))).otherwise(1.0 - F.try_divide("a", "b")))
        .where("value is not null")
        .select("series", "instance", "us", "event_id", "value")
    )
    errors = raw.where(F.col("metric") == ERROR_COUNTER).select("job", "instance", "us", "event_id", "value")
    grown = _increments(errors, ["job", "instance"], width)
    # A sum over a trailing window of all workers needs no series of its own: increments are added per moment.
    per_moment = grown.groupBy("us").agg(F.sum("__inc").alias("__inc"), F.max("event_id").alias("event_id"))
    summed = _trailing_sum(per_moment, [], seconds, width).select(
        F.lit(ERROR_SERIES).alias("series"), F.lit(None).cast(raw.schema["instance"].dataType).alias("instance"),
        "us", "event_id", F.col("increase").cast("double").alias("value"),
    )
    return out.unionByName(ratios).unionByName(summed)


# Default upper bounds of a duration histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def duration_histogram(samples: DataFrame, by: str, buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts with sum and count per ``by``.

    Every sample falls into one bucket first, so the exchange carries one row per bucket
    and task; the running sum then sees only the buckets.
    """
    slot = F.lit(len(buckets))
    for i, le in reversed(list(enumerate(buckets))):
        slot = F.when(F.col("value") <= le, F.lit(i)).otherwise(slot)
    counted = samples.groupBy(by, slot.alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    bounds = [str(float(b)) for b in buckets] + ["+Inf"]
    wide = counted.groupBy(by).agg(
        *[F.coalesce(F.sum(F.when(F.col("__b") <= i, F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(len(bounds))],
        F.sum("s").alias("sum"),
        F.sum("n").alias("count"),
    )
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)])
    return wide.select(by, F.inline(rows), "sum", "count")


def request_counts(requests: DataFrame) -> DataFrame:
    """L7."""
    return requests.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"))


def tasks_by_stage(status: DataFrame) -> DataFrame:
    """Tasks per current stage and failure code (``status`` has one row per task)."""
    return status.groupBy(
        "stage", F.when(F.col("stage") == "failed", F.col("error_code")).alias("error_code")
    ).agg(F.count(F.lit(1)).alias("tasks"))


def task_totals(status: DataFrame) -> DataFrame:
    """Created, failed and completed totals."""
    return status.agg(
        F.count(F.lit(1)).alias("created"),
        F.count_if(F.col("stage") == "failed").alias("failed"),
        F.count_if(F.col("stage") == "completed").alias("completed"),
    )
