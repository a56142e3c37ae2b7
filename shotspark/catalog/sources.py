"""A: sources and sinks.  Files themselves are covered by the tests; the queries run the
parsing and formatting over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.coordinates import RATED_SQL
from shotspark.catalog.results import documents, status_rows
from shotspark.catalog.results import ORACLE as RESULTS_ORACLE
from shotspark.fixtures import with_views
from shotspark.sources import envelopes as env
from shotspark.sources import files

QUERIES: dict = {}
ORACLE: dict = {}


def read_envelopes(spark, d):
    e = fx.envelopes(spark, d).drop("task_id")
    bad = {3: None, 4: "[1, 2]", 5: '{"task_id":"x","props":{"k":"abc"}}', 6: '{"props":{"k":1}}'}
    payload = F.col("payload")
    for rest, text in bad.items():
        payload = F.when(F.col("event_id") % 14 == rest, F.lit(text)).otherwise(payload)
    schema = "task_id STRING, props STRUCT<k: BIGINT>"
    out = env.read_envelopes(e.withColumn("payload", payload), schema, "click", ["task_id"])
    return out.select("event_id", "task_id", F.col("props.k").alias("k"), "error")


QUERIES["read_envelopes"] = read_envelopes
ORACLE["read_envelopes"] = """
SELECT event_id, CASE WHEN event_id % 14 NOT IN (3, 4, 5, 6) THEN CAST(user_id AS VARCHAR) END AS task_id,
    CASE WHEN event_id % 14 NOT IN (3, 4, 5, 6) THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k,
    CASE event_id % 14 WHEN 3 THEN 'message does not contain payload' WHEN 4 THEN 'payload is not a JSON object'
        WHEN 5 THEN 'payload does not match the schema' WHEN 6 THEN 'payload lacks task_id' END AS error
FROM events WHERE event_type = 'click'"""


def emit_envelopes(spark, d):
    rows = fx.chunk_arrivals(spark, d).select("task_id", "chunk_index", "event_id")
    return env.emit_envelopes(rows, "FrameBatch")


QUERIES["emit_envelopes"] = emit_envelopes
ORACLE["emit_envelopes"] = with_views(
    """SELECT 'FrameBatch' AS event_type, '1' AS schema_version, concat('{"task_id":', task_id, ',"chunk_index":', chunk_index, ',"event_id":', event_id, '}') AS payload FROM chunk_arrivals""",
    "chunk_arrivals",
)


def write_annotations(spark, d):
    return files.annotations_to_json(fx.annotations(spark, d))


QUERIES["write_annotations"] = write_annotations
ORACLE["write_annotations"] = with_views(
    """SELECT concat('{"', video_id, '":{"transitions":[', string_agg(concat('[', start_frame, ',', end_frame, ']'), ',' ORDER BY start_frame, end_frame), '],"frame_num":1200}}') AS value
    FROM annotations GROUP BY video_id""",
    "annotations",
)


def read_annotations(spark, d):
    back = files.annotations_from_json(files.annotations_to_json(fx.annotations(spark, d)))
    return back.select("video_id", F.col("pos").cast("bigint").alias("pos"), "start_frame", "end_frame", "frame_num")


QUERIES["read_annotations"] = read_annotations
ORACLE["read_annotations"] = with_views(
    """SELECT CAST(video_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, end_frame) - 1 AS pos, start_frame, end_frame, CAST(1200 AS BIGINT) AS frame_num FROM annotations""",
    "annotations",
)


def read_probe(spark, d):
    v = fx.videos(spark, d)
    i = F.col("video_id")
    probe = F.when(i % 10 == 9, F.lit('{"streams":[],"format":{}}')).otherwise(
        F.format_string(
            '{"streams":[{"width":%s,"height":%d,"avg_frame_rate":"%s","r_frame_rate":"%s","nb_frames":"%s","nb_read_frames":"%d","codec_name":"%s"}],"format":{"duration":"%s"}}',
            F.when(i % 10 == 8, F.lit('"x"')).otherwise(F.col("width").cast("string")), "height", "avg_frame_rate",
            F.when(i % 20 == 7, F.lit("0/1")).otherwise(F.col("r_frame_rate")),
            F.when(i % 3 == 0, F.lit("N/A")).otherwise(F.col("frame_count").cast("string")),
            F.col("frame_count") + 1,
            F.when(i % 2 == 0, F.lit("h264")).otherwise(F.lit("")),
            F.when(i % 4 == 1, F.lit("10.5")).otherwise(F.lit("N/A")),
        )
    )
    return files.read_probe(v.select("video_id", probe.alias("probe")))


QUERIES["read_probe"] = read_probe
ORACLE["read_probe"] = with_views(
    """SELECT video_id, CASE WHEN i <> 9 AND NOT norate THEN fps END AS fps, CASE WHEN i <> 9 THEN n END AS frame_count, CASE WHEN i < 8 THEN CAST(width AS INTEGER) END AS width, CASE WHEN i <> 9 THEN CAST(height AS INTEGER) END AS height,
    CASE WHEN i = 9 THEN NULL WHEN video_id % 4 = 1 THEN 10.5::DOUBLE WHEN NOT norate THEN CAST(n AS DOUBLE) / fps END AS duration_seconds, CASE WHEN i <> 9 AND video_id % 2 = 0 THEN 'h264' END AS codec,
    CASE WHEN i = 9 THEN 'no decodable video stream' WHEN i = 8 THEN 'width is invalid' WHEN norate THEN 'frame rate is invalid' END AS error
    FROM (SELECT *, video_id % 10 AS i, video_id % 20 = 7 AND avg_frame_rate = '0/0' AS norate, CASE WHEN video_id % 3 = 0 THEN frame_count + 1 ELSE frame_count END AS n FROM rated) q""",
    "videos", rated=RATED_SQL,
)


def read_results(spark, d):
    """Assembled documents, written as JSON text and parsed back."""
    docs = documents(spark, d)
    back = files.parse_results(files.results_to_json(docs), docs.schema)

    def text(col, fn):
        return F.array_join(F.transform(col, fn), ";")

    return back.select(
        "video_id", "part", "pipeline_version",
        text("scenes", lambda s: F.concat(s["start_frame"].cast("string"), F.lit("-"), s["end_frame"].cast("string"))).alias("scenes"),
        text("transitions", lambda t: F.concat(t["type"], t["end_frame"].cast("string"))).alias("transitions"),
        F.size("tracks").cast("bigint").alias("n_tracks"),
        F.aggregate("tracks", F.lit(0).cast("bigint"), lambda acc, t: acc + t["frame"]).alias("frame_sum"),
        F.col("video.frame_count").alias("frame_count"),
        F.col("timings.total_ms").alias("total_ms"),
        text("warnings", lambda w: F.concat(w["warning"], F.lit(":"), w["chunks"].cast("string"))).alias("warnings"),
    )


QUERIES["read_results"] = read_results
ORACLE["read_results"] = RESULTS_ORACLE["assemble_results"]


def result_state(spark, d):
    stored = fx.videos(spark, d).where("video_id % 5 <> 3").select("video_id", F.lit(0).cast("bigint").alias("part"))
    status = status_rows(spark, d).withColumn("error_code", F.when(F.col("video_id") % 4 == 1, F.lit("ingest_failed")))
    return files.result_state(status, stored)


QUERIES["result_state"] = result_state
ORACLE["result_state"] = with_views(
    """SELECT video_id, CASE WHEN video_id % 6 = 1 THEN 'failed' WHEN video_id % 5 <> 3 THEN 'ready' ELSE 'pending' END AS state,
    CASE WHEN video_id % 6 = 1 THEN CASE WHEN video_id % 4 = 1 THEN 'ingest_failed' ELSE 'processing_failed' END END AS error_code,
    CASE WHEN video_id % 6 = 1 THEN CASE WHEN video_id % 12 = 1 THEN 'decoder crashed' ELSE '' END END AS error_detail FROM videos""",
    "videos",
)


def dead_letters(spark, d):
    t = fx.table(spark, d, "documents")
    return files.dead_letters(
        t.select(
            F.lit("chunks").alias("source_stream"), F.col("doc_id").alias("source_event_id"),
            F.concat(F.col("source"), F.lit("-worker")).alias("worker"), F.col("text").alias("error"),
            F.to_json(F.struct("doc_id", "lang")).alias("payload"),
        )
    )


QUERIES["dead_letters"] = dead_letters
ORACLE["dead_letters"] = """
SELECT 'chunks' AS source_stream, CAST(doc_id AS VARCHAR) AS source_event_id, concat(source, '-worker') AS worker, substring(text, 1, 2000) AS error,
    concat('{"doc_id":', doc_id, ',"lang":"', lang, '"}') AS payload FROM documents"""
