"""H: delivery semantics over ``chunk_arrivals``, ``envelopes`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.fixtures import with_views
from shotspark.functions.paths import extract_task_id
from shotspark.operators import delivery as dl
from shotspark.operators.ordered import micros

QUERIES: dict = {}
ORACLE: dict = {}

#: Moment at which ages are measured: a second after the last event.
AS_OF = "(SELECT max(ts) + INTERVAL 1 SECOND FROM events)"
US = "CAST(epoch_us({c}) AS BIGINT)"


def as_of(spark, d):
    last = fx.table(spark, d, "events").agg(F.max("ts").cast("string")).first()[0]
    return F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 SECOND")


def arrivals(spark, d):
    """Arrivals with repeated deliveries 90 seconds later."""
    a = fx.chunk_arrivals(spark, d)
    again = a.where("event_id % 13 = 0").select(
        "task_id", "chunk_index", (F.col("arrived_at") + F.expr("INTERVAL 90 SECONDS")).alias("arrived_at"),
        (F.col("event_id") + 1_000_000_000).alias("event_id"),
    )
    return a.unionByName(again)


ARRIVALS = """
SELECT * FROM chunk_arrivals UNION ALL SELECT task_id, chunk_index, arrived_at + INTERVAL 90 SECONDS, event_id + 1000000000 FROM chunk_arrivals WHERE event_id % 13 = 0"""


def publish_once(spark, d):
    return dl.publish_once(arrivals(spark, d)).select("task_id", "chunk_index", "event_id", micros(F.col("arrived_at")).alias("us"))


QUERIES["publish_once"] = publish_once
ORACLE["publish_once"] = with_views(
    f"""SELECT task_id, chunk_index, event_id, {US.format(c='arrived_at')} AS us FROM (SELECT *, row_number() OVER (PARTITION BY task_id, chunk_index ORDER BY arrived_at, event_id) AS rn
    FROM arrivals) q WHERE rn = 1""",
    "chunk_arrivals", arrivals=ARRIVALS,
)


def published_counts(spark, d):
    return dl.published_counts(arrivals(spark, d))


QUERIES["published_counts"] = published_counts
ORACLE["published_counts"] = with_views(
    "SELECT task_id, count(DISTINCT chunk_index) AS published FROM arrivals GROUP BY 1", "chunk_arrivals", arrivals=ARRIVALS
)


def contiguous_dispatch(spark, d):
    out = dl.contiguous_dispatch(arrivals(spark, d))
    return out.select("task_id", "chunk_index", micros(F.col("arrived_at")).alias("arrived_us"), micros(F.col("dispatched_at")).alias("dispatched_us"))


QUERIES["contiguous_dispatch"] = contiguous_dispatch
ORACLE["contiguous_dispatch"] = with_views(
    f"""SELECT task_id, chunk_index, {US.format(c='a')} AS arrived_us, {US.format(c='m')} AS dispatched_us FROM (
    SELECT *, row_number() OVER w - 1 AS n, max(a) OVER w AS m FROM (SELECT task_id, chunk_index, min(arrived_at) AS a FROM arrivals GROUP BY 1, 2) p
    WINDOW w AS (PARTITION BY task_id ORDER BY chunk_index)) q WHERE n = chunk_index""",
    "chunk_arrivals", arrivals=ARRIVALS,
)


def attempts(spark, d):
    """Four tries per chunk, each wave shifted, so that holes close over time."""
    a = fx.chunk_arrivals(spark, d)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    return a.select("*", k).select(
        "task_id", "chunk_index",
        F.timestamp_micros(
            micros(F.col("arrived_at"))
            + F.col("k") * 3_000_000_000_000
            - F.when(F.col("k") > 0, (F.col("event_id") * 7919 % 1000) * 2_000_000_000 - F.col("chunk_index") * 60_000_000_000).otherwise(0)
        ).alias("arrived_at"),
        (F.col("event_id") * 4 + F.col("k")).alias("event_id"),
    )


ATTEMPTS = """
SELECT task_id, chunk_index, epoch_us(arrived_at) + k * 3000000000000 - CASE WHEN k > 0 THEN (event_id * 7919 % 1000) * 2000000000 - chunk_index * 60000000000 ELSE 0 END AS us,
    event_id * 4 + k AS event_id FROM (SELECT *, unnest(range(0, 4)) AS k FROM chunk_arrivals) q"""


def ordered_publish(spark, d):
    return dl.ordered_publish(attempts(spark, d)).select("task_id", "chunk_index", "event_id", "outcome")


def ordered_publish_large(spark, d):
    """The same rule with blocks so short that every task has many."""
    return dl.ordered_publish(attempts(spark, d), block=8).select("task_id", "chunk_index", "event_id", "outcome")


PUBLISH = with_views(
    """SELECT task_id, chunk_index, event_id, outcome FROM walk""",
    "chunk_arrivals", attempts=ATTEMPTS,
    numbered="SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY us, event_id) AS n FROM attempts",
    walk="""
WITH RECURSIVE w AS (
    SELECT task_id, chunk_index, event_id, n, CASE WHEN chunk_index = 0 THEN 1 ELSE 0 END AS expected,
        CASE WHEN chunk_index = 0 THEN 'published' ELSE 'rejected' END AS outcome FROM numbered WHERE n = 1
    UNION ALL
    SELECT a.task_id, a.chunk_index, a.event_id, a.n, CASE WHEN a.chunk_index = w.expected THEN w.expected + 1 ELSE w.expected END,
        CASE WHEN a.chunk_index = w.expected THEN 'published' WHEN a.chunk_index < w.expected THEN 'duplicate' ELSE 'rejected' END
    FROM w JOIN numbered a ON a.task_id = w.task_id AND a.n = w.n + 1)
SELECT * FROM w""",
)
QUERIES["ordered_publish"] = ordered_publish
ORACLE["ordered_publish"] = PUBLISH
QUERIES["ordered_publish_large"] = ordered_publish_large
ORACLE["ordered_publish_large"] = PUBLISH


def enrich_jobs(spark, d):
    a = fx.chunk_arrivals(spark, d)
    sources = fx.videos(spark, d).select(
        F.col("video_id").alias("task_id"),
        F.when(F.col("video_id") % 3 == 0, F.lit(None)).when(F.col("video_id") % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("car"), F.lit("bus"))).alias("tracking_classes"),
    )
    out = dl.enrich_jobs(a, sources)
    return out.select("task_id", "chunk_index", F.coalesce(F.array_join("tracking_classes", ","), F.lit("<default>")).alias("classes"), "cut_verified")


QUERIES["enrich_jobs"] = enrich_jobs
ORACLE["enrich_jobs"] = with_views(
    "SELECT task_id, chunk_index, CASE task_id % 3 WHEN 0 THEN '<default>' WHEN 1 THEN '' ELSE 'car,bus' END AS classes, true AS cut_verified FROM chunk_arrivals",
    "chunk_arrivals",
)


def _tracking(spark, d):
    return fx.chunk_arrivals(spark, d).where("chunk_index % 10 < 8").select("task_id", "chunk_index", "event_id")


def reject_unverified(spark, d):
    cuts = fx.chunk_arrivals(spark, d).where("event_id % 7 <> 0")
    good, bad = dl.reject_unverified(_tracking(spark, d), cuts)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


QUERIES["reject_unverified"] = reject_unverified
ORACLE["reject_unverified"] = with_views(
    "SELECT task_id, chunk_index, event_id, event_id % 7 <> 0 AS accepted FROM chunk_arrivals WHERE chunk_index % 10 < 8", "chunk_arrivals"
)


def _tasks(spark, d):
    return fx.videos(spark, d).select(
        F.col("video_id").alias("task_id"),
        F.when(F.col("video_id") % 4 == 0, 0).when(F.col("video_id") % 4 == 1, F.col("frame_count"))
        .otherwise(F.expr("frame_count div 2")).cast("bigint").alias("total_chunks"),
    )


TASKS = "SELECT video_id AS task_id, CASE video_id % 4 WHEN 0 THEN 0 WHEN 1 THEN frame_count ELSE frame_count // 2 END AS total_chunks FROM videos"


def completed_tasks(spark, d):
    return dl.completed_tasks(arrivals(spark, d), _tasks(spark, d))


QUERIES["completed_tasks"] = completed_tasks
ORACLE["completed_tasks"] = with_views(
    """SELECT t.task_id, total_chunks, completed FROM tasks t JOIN (SELECT task_id, count(DISTINCT chunk_index) AS completed FROM arrivals GROUP BY 1) a
    ON a.task_id = t.task_id WHERE total_chunks > 0 AND completed >= total_chunks""",
    "videos", "chunk_arrivals", arrivals=ARRIVALS, tasks=TASKS,
)


def ingest_complete(spark, d):
    return dl.ingest_complete(arrivals(spark, d), _tasks(spark, d))


QUERIES["ingest_complete"] = ingest_complete
ORACLE["ingest_complete"] = with_views(
    """SELECT *, published >= total_chunks AS complete, CASE WHEN published < total_chunks THEN concat(CAST(published AS VARCHAR), '/', CAST(total_chunks AS VARCHAR)) END AS shortfall FROM (
    SELECT t.task_id, total_chunks, count(DISTINCT chunk_index) AS published FROM tasks t LEFT JOIN arrivals a ON a.task_id = t.task_id GROUP BY 1, 2) q""",
    "videos", "chunk_arrivals", arrivals=ARRIVALS, tasks=TASKS,
)


def partition_by_task(spark, d):
    e = fx.envelopes(spark, d).withColumn("task_id", F.when(F.col("event_id") % 7 == 0, F.col("task_id")))
    # Rows of one partition and task carry increasing ids exactly when the order held.
    return dl.partition_by_task(e).select("event_id", "partition_key")


QUERIES["partition_by_task"] = partition_by_task
ORACLE["partition_by_task"] = with_views(
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN task_id ELSE concat('event:', CAST(event_id AS VARCHAR)) END AS partition_key FROM envelopes",
    "envelopes",
)


def task_ids(spark, d):
    e = fx.envelopes(spark, d)
    payload = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).when(F.col("event_id") % 10 == 4, F.lit("[1]")).otherwise(F.col("payload"))
    return e.select("event_id", extract_task_id(F.col("task_id"), payload).alias("task_id"))


QUERIES["extract_task_id"] = task_ids
ORACLE["extract_task_id"] = "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 10 NOT IN (3, 4) THEN CAST(user_id AS VARCHAR) END AS task_id FROM events"

FAILS = """
SELECT event_id % 3001 AS message_id, event_id AS attempt_no, CASE WHEN event_id % 17 = 5 THEN 'terminal' WHEN event_id % 3 = 0 THEN 'transient' ELSE 'other' END AS kind,
    concat(event_type, '-worker') AS worker, concat('failed ', props) AS error FROM events"""


def route_failures(spark, d):
    rows = spark.sql(FAILS.replace("FROM events", "FROM {events}"), events=fx.table(spark, d, "events"))
    return dl.route_failures(rows)


QUERIES["route_failures"] = route_failures
ORACLE["route_failures"] = f"""
SELECT message_id, CASE WHEN e IS NULL THEN 'pending' ELSE 'dead_letter' END AS route, coalesce(e, last) AS attempt_no, err AS error,
    CASE WHEN k = 'other' THEN concat(replace(wk, '-', '_'), '_failed') END AS task_error_code FROM (
    SELECT message_id, max(attempt_no) AS last, min(attempt_no) FILTER (WHERE ends) AS e, arg_min(error, attempt_no) FILTER (WHERE ends) AS err,
        arg_min(kind, attempt_no) FILTER (WHERE ends) AS k, arg_min(worker, attempt_no) FILTER (WHERE ends) AS wk FROM (
    SELECT *, kind = 'terminal' OR (kind = 'other' AND count(*) FILTER (WHERE kind = 'other') OVER (PARTITION BY message_id ORDER BY attempt_no) >= 3) AS ends FROM ({FAILS}) f) a
    GROUP BY message_id) b"""


def stalled_tasks(spark, d):
    return dl.stalled_tasks(fx.status_updates(spark, d), as_of(spark, d), 6 * 3600)


QUERIES["stalled_tasks"] = stalled_tasks
ORACLE["stalled_tasks"] = with_views(
    f"""SELECT task_id, stage, epoch_us({AS_OF}) - epoch_us(ts) AS idle_us FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn
    FROM status_updates) q WHERE rn = 1 AND stage NOT IN ('completed', 'failed') AND epoch_us({AS_OF}) - epoch_us(ts) >= 21600000000""",
    "status_updates",
)


def in_flight(spark, d):
    a = fx.chunk_arrivals(spark, d).select("task_id", micros(F.col("arrived_at")).alias("us"), "event_id")
    done = a.select("task_id", (F.col("us") + (F.col("event_id") % 7200 + 1) * 1_000_000).alias("us"), "event_id")
    return dl.in_flight(a, done)


QUERIES["in_flight"] = in_flight
ORACLE["in_flight"] = with_views(
    """SELECT task_id, us, event_id, delta, task_in_flight, total_in_flight, active_tasks, task_in_flight > CASE WHEN active_tasks > 1 THEN 1 ELSE 2 END AS over_task, total_in_flight > 2 AS over_total FROM (
    SELECT *, CAST(sum(delta) OVER g AS BIGINT) AS total_in_flight,
        CAST(sum(CASE WHEN delta = 1 AND task_in_flight = 1 THEN 1 WHEN delta = -1 AND task_in_flight = 0 THEN -1 ELSE 0 END) OVER g AS BIGINT) AS active_tasks FROM (
    SELECT *, CAST(sum(delta) OVER (PARTITION BY task_id ORDER BY us, delta, event_id) AS BIGINT) AS task_in_flight FROM (
    SELECT task_id, epoch_us(arrived_at) AS us, event_id, 1 AS delta FROM chunk_arrivals UNION ALL
    SELECT task_id, epoch_us(arrived_at) + (event_id % 7200 + 1) * 1000000, event_id, -1 FROM chunk_arrivals) a) b WINDOW g AS (ORDER BY us, delta, event_id, task_id ROWS UNBOUNDED PRECEDING)) c""",
    "chunk_arrivals",
)


def retain(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("stream"), "ts", "event_id")
    return dl.retain(e, as_of(spark, d), 7 * 86_400, 300).select("stream", "event_id")


QUERIES["retain"] = retain
ORACLE["retain"] = f"""
SELECT stream, event_id FROM (SELECT event_type AS stream, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events
    WHERE epoch_us({AS_OF}) - epoch_us(ts) < 604800000000) q WHERE rn <= 300"""


def skip_terminal(spark, d):
    jobs = fx.chunk_arrivals(spark, d).select("task_id", "chunk_index")
    status = fx.videos(spark, d).select(
        F.col("video_id").alias("task_id"),
        F.when(F.col("video_id") % 5 == 0, "completed").when(F.col("video_id") % 5 == 1, "failed").otherwise("tracking").alias("stage"),
        (F.col("video_id") % 7 == 0).alias("ingest_complete"),
    )
    return dl.skip_terminal(jobs, status)


QUERIES["skip_terminal"] = skip_terminal
ORACLE["skip_terminal"] = with_views(
    "SELECT task_id, chunk_index FROM chunk_arrivals WHERE task_id % 5 NOT IN (0, 1) AND task_id % 7 <> 0", "chunk_arrivals"
)


def unacked_stale(spark, d):
    e = fx.table(spark, d, "events")
    deliveries = e.select((F.col("event_id") % 4001).alias("message_id"), F.col("ts").alias("touched_at"))
    acks = e.where("event_id % 5 = 0").select((F.col("event_id") % 4001).alias("message_id"))
    return dl.unacked_stale(deliveries, acks, as_of(spark, d), 3600)


QUERIES["unacked_stale"] = unacked_stale
ORACLE["unacked_stale"] = f"""
SELECT message_id, epoch_us({AS_OF}) - epoch_us(max(ts)) AS idle_us FROM (SELECT *, event_id % 4001 AS message_id FROM events) q
GROUP BY message_id HAVING count(*) FILTER (WHERE event_id % 5 = 0) = 0 AND epoch_us({AS_OF}) - epoch_us(max(ts)) >= 3600000000"""
