"""I: the status machine over ``status_updates``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.fixtures import with_views
from shotspark.operators import status as st
from shotspark.operators.ordered import micros

QUERIES: dict = {}
ORACLE: dict = {}

# The stage table once more, in full, so that a wrong entry of the library's shows.
RANK = """CASE {s} WHEN 'queued' THEN 0 WHEN 'downloading' THEN 1 WHEN 'decoding' THEN 2 WHEN 'cut_detection' THEN 3
    WHEN 'tracking' THEN 4 WHEN 'aggregating' THEN 5 WHEN 'completed' THEN 6 WHEN 'failed' THEN 6 END"""
EDGES = """'queued>downloading', 'queued>decoding', 'queued>failed', 'downloading>decoding', 'downloading>failed', 'decoding>cut_detection',
    'decoding>failed', 'cut_detection>tracking', 'cut_detection>failed', 'tracking>aggregating', 'tracking>failed', 'aggregating>completed',
    'aggregating>failed'"""


def validate_stage_path(spark, d):
    out = st.validate_stage_path(fx.status_updates(spark, d))
    return out.select("task_id", "seq", "previous_stage", "stage", "valid")


QUERIES["validate_stage_path"] = validate_stage_path
ORACLE["validate_stage_path"] = with_views(
    f"""SELECT task_id, seq, previous_stage, stage, previous_stage = stage OR concat(previous_stage, '>', stage) IN ({EDGES}) AS valid FROM (
    SELECT *, coalesce(lag(stage) OVER (PARTITION BY task_id ORDER BY seq), 'queued') AS previous_stage FROM status_updates WHERE stage <> '') q""",
    "status_updates",
)


def rich_updates(spark, d):
    """Updates with a message on most rows, error texts on failures and absent progress."""
    u = fx.status_updates(spark, d)
    return u.withColumns(
        {
            "progress": F.when(F.col("seq") % 6 != 1, F.col("progress")),
            "message": F.when(F.col("seq") % 5 != 0, F.concat(F.lit("m"), F.col("seq").cast("string"))).otherwise(F.lit("")),
            "total_chunks": F.when(F.col("seq") % 9 == 0, F.col("seq") % 70),
            "error_code": F.when(F.col("stage") == "failed", F.lit("cut_failed")),
            "error_detail": F.when(F.col("stage") == "failed", F.repeat(F.col("seq").cast("string"), 900)),
        }
    )


WALK = {
    "rich": """
SELECT task_id, seq, ts, stage, cut_completed, CASE WHEN seq % 6 <> 1 THEN progress END AS progress, CASE WHEN seq % 5 <> 0 THEN concat('m', CAST(seq AS VARCHAR)) ELSE '' END AS message,
    CASE WHEN seq % 9 = 0 THEN seq % 70 END AS total_chunks, CASE WHEN stage = 'failed' THEN 'cut_failed' END AS error_code,
    CASE WHEN stage = 'failed' THEN substring(repeat(CAST(seq AS VARCHAR), 900), 1, 2000) END AS error_detail,
    row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM status_updates""",
    "walk": f"""
WITH RECURSIVE w AS (
    SELECT task_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'queued' AS current, 'queued' AS stage_after, 'start' AS verdict, CAST(0 AS DOUBLE) AS progress,
        CAST(NULL AS VARCHAR) AS message, CAST(0 AS BIGINT) AS cut_completed, CAST(0 AS BIGINT) AS total_chunks, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS error_detail,
        CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS updated FROM rich WHERE n = 1
    UNION ALL
    SELECT task_id, n, seq, before, after, v, CASE WHEN ok THEN p2 ELSE p1 END,
        CASE WHEN v = 'applied' AND m2 <> '' AND (rp IS NULL OR rp >= p2) THEN m2 ELSE m1 END,
        CASE WHEN ok THEN greatest(c1, c2) ELSE c1 END, CASE WHEN ok THEN greatest(t1, coalesce(t2, 0)) ELSE t1 END,
        CASE WHEN ok THEN coalesce(e2, e1) ELSE e1 END, CASE WHEN ok THEN coalesce(d2, d1) ELSE d1 END,
        CASE WHEN ok AND s1 IS NULL AND after <> 'queued' THEN ts ELSE s1 END, CASE WHEN ok THEN ts ELSE u1 END
    FROM (SELECT *, v IN ('applied', 'stale') AS ok, CASE WHEN v = 'applied' AND stage <> '' THEN stage ELSE before END AS after FROM (
        SELECT r.task_id, r.n, r.seq, r.ts, r.stage, w.stage_after AS before, CASE WHEN w.stage_after IN ('completed', 'failed') THEN 'ignored'
            WHEN r.stage = '' OR r.stage = w.stage_after THEN 'applied' WHEN concat(w.stage_after, '>', r.stage) IN ({EDGES}) THEN 'applied'
            WHEN {RANK.format(s='r.stage')} < {RANK.format(s='w.stage_after')} THEN 'stale' ELSE 'rejected' END AS v,
            w.progress AS p1, greatest(w.progress, coalesce(r.progress, 0)) AS p2, r.progress AS rp, w.message AS m1, r.message AS m2, w.cut_completed AS c1, r.cut_completed AS c2,
            w.total_chunks AS t1, r.total_chunks AS t2, w.error_code AS e1, r.error_code AS e2, w.error_detail AS d1, r.error_detail AS d2, w.started AS s1, w.updated AS u1
        FROM w JOIN rich r ON r.task_id = w.task_id AND r.n = w.n + 1) a) b)
SELECT * FROM w""",
    "folded": """
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC) AS back FROM walk""",
}


def applied_updates(spark, d):
    return st.applied_updates(rich_updates(spark, d)).select("task_id", "seq", F.col("current").alias("stage_before"), "stage_after", "verdict")


QUERIES["applied_updates"] = applied_updates
ORACLE["applied_updates"] = with_views(
    "SELECT task_id, seq, current AS stage_before, stage_after, verdict FROM walk WHERE n > 0", "status_updates", **WALK
)


def fold_status(spark, d):
    f = st.fold_status(rich_updates(spark, d))
    return f.select(
        "task_id", "stage", "progress", "message", "cut_completed", "total_chunks", "error_code", "error_detail",
        micros(F.col("processing_started_at")).alias("started_us"), micros(F.col("updated_at")).alias("updated_us"),
    )


QUERIES["fold_status"] = fold_status
ORACLE["fold_status"] = with_views(
    """SELECT task_id, stage_after AS stage, progress, message, cut_completed, total_chunks, error_code, error_detail, epoch_us(started) AS started_us, epoch_us(updated) AS updated_us
    FROM folded WHERE back = 1""",
    "status_updates", **WALK,
)


def stage_progress(spark, d):
    u = fx.status_updates(spark, d)
    stage = F.when(F.col("seq") % 8 == 0, "ingest").when(F.col("seq") % 8 == 1, "completed").when(F.col("seq") % 8 == 2, "downloading").otherwise(F.col("stage"))
    total = F.when(F.col("seq") % 11 == 0, 0).otherwise(F.col("seq") % 37 + 4)
    return u.select("seq", st.stage_progress(stage, F.col("cut_completed"), total).alias("progress"))


QUERIES["stage_progress"] = stage_progress
ORACLE["stage_progress"] = with_views(
    """SELECT seq, CAST(CASE s WHEN 'downloading' THEN 2 WHEN 'decoding' THEN 5 WHEN 'ingest' THEN 8 + CAST(22 AS DOUBLE) * c / greatest(t, 1)
    WHEN 'cut_detection' THEN CASE WHEN t > 0 THEN 30 + 30 * least(CAST(c AS DOUBLE) / greatest(t, 1), 1) ELSE 30 END
    WHEN 'tracking' THEN CASE WHEN t > 0 THEN 60 + 30 * least(CAST(c AS DOUBLE) / greatest(t, 1), 1) ELSE 60 END WHEN 'completed' THEN 100 ELSE 0 END AS DOUBLE) AS progress
    FROM (SELECT seq, cut_completed AS c, CASE seq % 8 WHEN 0 THEN 'ingest' WHEN 1 THEN 'completed' WHEN 2 THEN 'downloading' ELSE stage END AS s,
        CASE WHEN seq % 11 = 0 THEN 0 ELSE seq % 37 + 4 END AS t FROM status_updates) q""",
    "status_updates",
)


def progress_ticks(spark, d):
    a = fx.chunk_arrivals(spark, d)
    kind = F.when(F.col("event_id") % 3 == 0, "ingest").when(F.col("event_id") % 3 == 1, "cut").otherwise("tracking")
    tick = st.progress_ticks(kind, F.col("chunk_index") + 1, F.col("task_id") % 60, F.col("event_id") % 23 == 0)
    return a.where(tick).select("event_id", "task_id", "chunk_index")


QUERIES["progress_ticks"] = progress_ticks
ORACLE["progress_ticks"] = with_views(
    """SELECT event_id, task_id, chunk_index FROM (SELECT *, chunk_index + 1 AS n, task_id % 60 AS t FROM chunk_arrivals) q WHERE CASE event_id % 3
    WHEN 0 THEN n = 1 OR n >= t OR n % 5 = 0 WHEN 1 THEN event_id % 23 = 0 OR (t > 0 AND n >= t) OR n % 5 = 0 ELSE (t > 0 AND n >= t) OR n % 5 = 0 END""",
    "chunk_arrivals",
)


def current_status(spark, d):
    u = fx.status_updates(spark, d)
    wanted = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return st.current_status(u, wanted).select("task_id", "seq", "stage", "progress", "found")


QUERIES["current_status"] = current_status
ORACLE["current_status"] = with_views(
    """SELECT c_custkey AS task_id, seq, stage, progress, seq IS NOT NULL AS found FROM customer LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM status_updates) u ON u.task_id = c_custkey AND rn = 1""",
    "status_updates",
)


def _latest(spark, d):
    u = fx.status_updates(spark, d)
    tasks = u.select("task_id").distinct()
    s = st.current_status(u, tasks).withColumn("progress", F.round(F.col("progress") * 100).cast("bigint"))
    return s, tasks.select((F.col("task_id") % 13).alias("archive_id"), "task_id", F.col("task_id").alias("ord"))


LATEST = """
SELECT task_id, stage, CAST(round(progress * 100) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM status_updates) q WHERE rn = 1"""


def batch_progress(spark, d):
    s, tasks = _latest(spark, d)
    return st.batch_progress(s, tasks)


QUERIES["batch_progress"] = batch_progress
ORACLE["batch_progress"] = with_views(
    """SELECT task_id % 13 AS archive_id, CAST(sum(cents) AS DOUBLE) / count(*) AS mean_progress, count(*) FILTER (WHERE stage IN ('completed', 'failed')) AS finished, count(*) AS tasks,
    coalesce(arg_min(stage, task_id) FILTER (WHERE stage NOT IN ('completed', 'failed')), 'completed') AS active_stage FROM latest GROUP BY 1""",
    "status_updates", latest=LATEST,
)


def processing_started_at(spark, d):
    out = st.processing_started_at(st.applied_updates(rich_updates(spark, d)))
    return out.select("task_id", micros(F.col("processing_started_at")).alias("started_us"))


QUERIES["processing_started_at"] = processing_started_at
ORACLE["processing_started_at"] = with_views(
    "SELECT task_id, epoch_us(started) AS started_us FROM folded WHERE back = 1", "status_updates", **WALK
)


def stage_changes(spark, d):
    return st.stage_changes(fx.status_updates(spark, d)).select("task_id", "seq", "stage")


QUERIES["stage_changes"] = stage_changes
ORACLE["stage_changes"] = with_views(
    "SELECT task_id, seq, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY task_id ORDER BY seq) AS b FROM status_updates) q WHERE b IS DISTINCT FROM stage",
    "status_updates",
)
