"""L: metric windows over ``metric_samples`` and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.fixtures import with_views
from shotspark.operators import metrics as mt
from shotspark.operators import status as st
from shotspark.catalog.status import WALK, rich_updates
from shotspark.operators.ordered import micros

QUERIES: dict = {}
ORACLE: dict = {}

INCREASES = """
SELECT worker, event_id, epoch_us(ts) AS us, value, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (
    SELECT *, lag(value) OVER (PARTITION BY worker ORDER BY ts, event_id) AS p FROM metric_samples) q"""
WINDOWED = """
SELECT worker, event_id, value, CAST(sum(inc) OVER (PARTITION BY worker ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM increases"""


def samples(spark, d):
    return fx.metric_samples(spark, d).select("worker", micros(F.col("ts")).alias("us"), "event_id", "value")


def counter_increase(spark, d):
    return mt.counter_increase(samples(spark, d), ["worker"]).select("worker", "event_id", "value", "increase")


QUERIES["counter_increase"] = counter_increase
ORACLE["counter_increase"] = with_views(WINDOWED, "metric_samples", increases=INCREASES)


def counter_rate(spark, d):
    return mt.counter_rate(samples(spark, d), ["worker"]).select("worker", "event_id", "rate")


QUERIES["counter_rate"] = counter_rate
ORACLE["counter_rate"] = with_views(
    f"SELECT worker, event_id, increase / CAST(300 AS DOUBLE) AS rate FROM ({WINDOWED}) w", "metric_samples", increases=INCREASES
)


def latest_sum(spark, d):
    return mt.latest_sum(samples(spark, d), ["worker"])


QUERIES["latest_sum"] = latest_sum
ORACLE["latest_sum"] = with_views(
    "SELECT CAST(sum(v) AS BIGINT) AS total FROM (SELECT arg_max(value, epoch_us(ts) * 1000 + event_id % 1000) AS v FROM metric_samples GROUP BY worker) q", "metric_samples"
)


def used_ratio(spark, d):
    s = samples(spark, d)
    free = s.select("event_id", F.col("value").alias("value"))
    total = s.select("event_id", (F.col("value") + F.col("event_id") % 90).alias("value"))
    keys = ["event_id"]
    host = mt.used_ratio(free, total, keys).withColumn("kind", F.lit("host"))
    return host.unionByName(mt.used_ratio(free, total, keys, of_sum=True).withColumn("kind", F.lit("gpu")))


QUERIES["used_ratio"] = used_ratio
ORACLE["used_ratio"] = with_views(
    """SELECT event_id, 'host' AS kind, 1 - CAST(value AS DOUBLE) / nullif(value + event_id % 90, 0) AS ratio FROM metric_samples
    UNION ALL SELECT event_id, 'gpu', CAST(value AS DOUBLE) / nullif(value + (value + event_id % 90), 0) FROM metric_samples""",
    "metric_samples",
)


def alert_for(spark, d):
    return mt.alert_for(samples(spark, d), ["worker"], F.col("value") % 100 < 60, 4 * 3600)


QUERIES["alert_for"] = alert_for
ORACLE["alert_for"] = with_views(
    """SELECT worker, min(us) AS since_us, max(us) AS until_us, count(*) AS samples FROM (SELECT *, n - row_number() OVER (PARTITION BY worker ORDER BY n) AS g FROM (
    SELECT worker, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) AS n FROM metric_samples) a WHERE value % 100 < 60) b
    GROUP BY worker, g HAVING max(us) - min(us) >= 14400000000""",
    "metric_samples",
)

#: The test counters as the series that the seven rules watch.
SERIES = {
    "backend_up": ("view", "CASE WHEN value % 40 < 12 THEN 0 ELSE 1 END"),
    "redis_up": ("click", "CASE WHEN value % 60 < 5 THEN 0 ELSE 1 END"),
    "memory_used_ratio": ("signup", "value / 500"),
    "gpu_temperature": ("error", "value / 5"),
    "gpu_memory_used_ratio": ("purchase", "value / 500"),
    "shm_used_ratio": ("view", "value / 500"),
    "worker_errors_increase": ("error", "value % 3"),
}


def evaluate_alerts(spark, d):
    own = None
    for series, (worker, expr) in SERIES.items():
        one = F.struct(F.lit(series).alias("series"), F.expr(expr).cast("double").alias("value"))
        test = F.col("worker") == worker
        own = [*(own or []), F.when(test, one)]
    made = samples(spark, d).select("us", "event_id", F.explode(F.array_compact(F.array(*own))).alias("s"))
    return mt.evaluate_alerts(made.select("s.series", "us", "event_id", "s.value"))


QUERIES["evaluate_alerts"] = evaluate_alerts
# The rules once more, in full, so that a wrong entry of the library's table shows.
_RULES = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS alert, '{severity}' AS severity, min(us) AS since_us, max(us) AS until_us FROM (SELECT us, n - row_number() OVER (ORDER BY n) AS g FROM (
    SELECT epoch_us(ts) AS us, CAST({SERIES[series][1]} AS DOUBLE) AS value, row_number() OVER (ORDER BY ts, event_id) AS n FROM metric_samples WHERE worker = '{SERIES[series][0]}') a
    WHERE {predicate}) b GROUP BY g HAVING max(us) - min(us) >= {us}"""
    for name, series, predicate, us, severity in (
        ("BackendUnavailable", "backend_up", "value = 0", 60_000_000, "critical"),
        ("RedisUnavailable", "redis_up", "value = 0", 60_000_000, "critical"),
        ("HostMemoryPressure", "memory_used_ratio", "value > 0.90", 300_000_000, "warning"),
        ("GPUHighTemperature", "gpu_temperature", "value > 85", 120_000_000, "warning"),
        ("GPUMemoryPressure", "gpu_memory_used_ratio", "value > 0.92", 180_000_000, "warning"),
        ("SharedMemoryPressure", "shm_used_ratio", "value > 0.85", 180_000_000, "warning"),
        ("PipelineWorkerErrors", "worker_errors_increase", "value > 0", 60_000_000, "warning"),
    )
)
ORACLE["evaluate_alerts"] = with_views(_RULES, "metric_samples")

#: Events as scrapes of raw gauges and counters: metric and job by event type and id.
RAW = """
SELECT CASE event_type WHEN 'view' THEN 'up' WHEN 'click' THEN 'cv_worker_errors_total' WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'node_memory_MemAvailable_bytes' ELSE 'node_memory_MemTotal_bytes' END
    WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'DCGM_FI_DEV_FB_USED' ELSE 'DCGM_FI_DEV_FB_FREE' END ELSE 'DCGM_FI_DEV_GPU_TEMP' END AS metric,
    CASE event_type WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'redis' ELSE 'other' END ELSE concat('w', CAST(event_id % 5 AS VARCHAR)) END AS job,
    CASE WHEN event_id % 7 < 4 THEN 'a' ELSE 'b' END AS instance, floor(epoch(ts) / 1800) * 1800000000 AS us, event_id,
    CASE event_type WHEN 'view' THEN CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END WHEN 'click' THEN floor(value) ELSE 10 + value END AS value FROM events"""


def raw_metrics(spark, d):
    e, kind, even = fx.table(spark, d, "events"), F.col("event_type"), F.col("event_id") % 2 == 0
    pick = lambda a, b: F.when(even, a).otherwise(b)
    return e.select(
        F.when(kind == "view", "up").when(kind == "click", "cv_worker_errors_total")
        .when(kind == "signup", pick("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"))
        .when(kind == "purchase", pick("DCGM_FI_DEV_FB_USED", "DCGM_FI_DEV_FB_FREE")).otherwise("DCGM_FI_DEV_GPU_TEMP").alias("metric"),
        F.when(kind == "view", F.element_at(F.array(F.lit("backend"), F.lit("redis"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")))
        .otherwise(F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string"))).alias("job"),
        F.when(F.col("event_id") % 7 < 4, "a").otherwise("b").alias("instance"),
        (F.floor(micros(F.col("ts")) / 1_800_000_000) * 1_800_000_000).alias("us"), "event_id",
        F.when(kind == "view", F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(0.0)).when(kind == "click", F.floor("value").cast("double"))
        .otherwise(10 + F.col("value")).alias("value"),
    )


def alert_series(spark, d):
    out = mt.alert_series(raw_metrics(spark, d), 4 * 3600)
    return out.select("series", "instance", "us", "event_id", "value")


QUERIES["alert_series"] = alert_series
ORACLE["alert_series"] = f"""
WITH raw AS (SELECT metric, job, instance, CAST(us AS BIGINT) AS us, event_id, CAST(value AS DOUBLE) AS value FROM ({RAW}) q),
pairs AS (SELECT p.s, p.summed, instance, us, max(event_id) AS event_id, arg_max(value, event_id) FILTER (WHERE metric = p.x) AS a, arg_max(value, event_id) FILTER (WHERE metric = p.y) AS b
    FROM raw JOIN (VALUES ('memory_used_ratio', 'node_memory_MemAvailable_bytes', 'node_memory_MemTotal_bytes', false), ('gpu_memory_used_ratio', 'DCGM_FI_DEV_FB_USED', 'DCGM_FI_DEV_FB_FREE', true)) p(s, x, y, summed)
    ON metric IN (p.x, p.y) GROUP BY ALL),
grown AS (SELECT us, event_id, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (
    SELECT *, lag(value) OVER (PARTITION BY job, instance ORDER BY us, event_id) AS p FROM raw WHERE metric = 'cv_worker_errors_total') g),
moments AS (SELECT us, max(event_id) AS event_id, sum(inc) AS inc FROM grown GROUP BY us)
SELECT CASE job WHEN 'backend' THEN 'backend_up' ELSE 'redis_up' END AS series, instance, us, event_id, value FROM raw WHERE metric = 'up' AND job IN ('backend', 'redis')
UNION ALL SELECT 'gpu_temperature', instance, us, event_id, value FROM raw WHERE metric = 'DCGM_FI_DEV_GPU_TEMP'
UNION ALL SELECT s, instance, us, event_id, CASE WHEN summed THEN a / nullif(a + b, 0) ELSE 1 - a / nullif(b, 0) END FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT 'worker_errors_increase', NULL, us, event_id, sum(inc) OVER (ORDER BY us RANGE BETWEEN 14399999999 PRECEDING AND CURRENT ROW) FROM moments"""


def duration_histogram(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("worker"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return mt.duration_histogram(e, "worker", (50, 100, 500, 1000, 2500, 5000, 10000))


QUERIES["duration_histogram"] = duration_histogram
ORACLE["duration_histogram"] = """
SELECT worker, le, count(*) FILTER (WHERE v <= b) AS cumulative, CAST(sum(v) AS BIGINT) AS sum, count(*) AS count FROM (
    SELECT event_type AS worker, CAST(round(value * 100) AS BIGINT) AS v FROM events) e,
    (VALUES ('50.0', 50), ('100.0', 100), ('500.0', 500), ('1000.0', 1000), ('2500.0', 2500), ('5000.0', 5000), ('10000.0', 10000), ('+Inf', 1000000000)) t(le, b) GROUP BY worker, le"""


def request_counts(spark, d):
    e = fx.table(spark, d, "events").select(
        F.when(F.col("event_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_id") % 19 == 0, 422).otherwise(200).cast("bigint").alias("status"),
    )
    return mt.request_counts(e)


QUERIES["request_counts"] = request_counts
ORACLE["request_counts"] = """
SELECT CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('/', event_type) AS path, CAST(CASE WHEN event_id % 19 = 0 THEN 422 ELSE 200 END AS BIGINT) AS status,
    count(*) AS requests FROM events GROUP BY 1, 2, 3"""


def tasks_by_stage(spark, d):
    return mt.tasks_by_stage(st.fold_status(rich_updates(spark, d)))


QUERIES["tasks_by_stage"] = tasks_by_stage
ORACLE["tasks_by_stage"] = with_views(
    "SELECT stage_after AS stage, CASE WHEN stage_after = 'failed' THEN error_code END AS error_code, count(*) AS tasks FROM folded WHERE back = 1 GROUP BY 1, 2", "status_updates", **WALK
)


def task_totals(spark, d):
    return mt.task_totals(st.fold_status(rich_updates(spark, d)))


QUERIES["task_totals"] = task_totals
ORACLE["task_totals"] = with_views(
    "SELECT count(*) AS created, count(*) FILTER (WHERE stage_after = 'failed') AS failed, count(*) FILTER (WHERE stage_after = 'completed') AS completed FROM folded WHERE back = 1",
    "status_updates", **WALK,
)
