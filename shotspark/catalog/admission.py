"""B: admission rules over ``manifest``, ``pages``, ``events`` and ``detections``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotspark import fixtures as fx
from shotspark.catalog.chunking import PLAN_SQL, small_plan
from shotspark.fixtures import with_views
from shotspark.functions import boxes, paths
from shotspark.operators import admission as adm
from shotspark.operators import validate as val

QUERIES: dict = {}
ORACLE: dict = {}

BASE = "regexp_extract(lower({f}), '([^/]*)$', 1)"
SUFFIX = "regexp_extract(regexp_extract(lower({f}), '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"
GOOD = "('.mp4', '.mov', '.mkv', '.avi', '.webm', '.m4v')"

#: Normalised names with the directory flag and the system-file test.
NAMED = f"""
SELECT *, CASE WHEN name IS NULL THEN NULL ELSE split_part(lower(name), '/', 1) = '__macosx'
    OR {BASE.format(f='name')} IN ('.ds_store', 'desktop.ini', 'thumbs.db') OR starts_with({BASE.format(f='name')}, '._') END AS sys
FROM (SELECT *, filename LIKE '%/' AS is_dir,
    CASE WHEN filename = '' OR length(filename) > 1024 OR starts_with(filename, '/') OR list_contains(p, '..') OR contains(p[1], ':') THEN NULL
    ELSE array_to_string(p, '/') END AS name
    FROM (SELECT *, list_filter(string_split(replace(filename, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')) AS p FROM manifest) a) b"""
MARKED = """
SELECT *, coalesce(NOT is_dir AND NOT sys, false) AND
    row_number() OVER (PARTITION BY archive_id, name, NOT is_dir AND NOT sys ORDER BY ord) > 1 AS is_duplicate FROM named"""
REPORT = f"""
SELECT *, reason IS NULL AS accepted FROM (SELECT archive_id, ord, filename, name, file_size,
    CASE WHEN name IS NULL THEN 'unsafe member path' WHEN sys THEN 'system file' WHEN is_duplicate THEN 'repeated member'
    WHEN {SUFFIX.format(f='name')} NOT IN {GOOD} THEN concat('suffix not allowed: ''',
        CASE WHEN {SUFFIX.format(f='name')} = '' THEN '<none>' ELSE {SUFFIX.format(f='name')} END, '''') END AS reason
    FROM marked WHERE NOT is_dir) q"""
ARCHIVES = {"named": NAMED, "marked": MARKED, "report": REPORT}

MIME = """CASE ord % 7 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'Video/MP4' WHEN 2 THEN '' WHEN 3 THEN 'application/octet-stream'
    WHEN 4 THEN 'text/plain' WHEN 5 THEN 'application/zip' ELSE NULL END"""


def admit_filename(spark, d):
    m = fx.manifest(spark, d).withColumn("mime", F.expr(MIME))
    name = F.when(F.col("ord") % 11 != 4, F.col("filename"))
    return m.select("ord", paths.admit_filename(name, F.col("mime")).alias("reason"))


QUERIES["admit_filename"] = admit_filename
ORACLE["admit_filename"] = with_views(
    f"""SELECT ord, CASE WHEN m LIKE 'audio/%' THEN 'audio only'
    WHEN s NOT IN {GOOD} THEN concat('suffix not allowed: ''', CASE WHEN s = '' THEN '<none>' ELSE s END, '''')
    WHEN m <> '' AND m NOT LIKE 'video/%' AND m <> 'application/octet-stream' THEN concat('content type not allowed: ''', m, '''') END AS reason
    FROM (SELECT ord, CASE WHEN ord % 11 = 4 THEN '' ELSE {SUFFIX.format(f='filename')} END AS s, lower(coalesce({MIME}, '')) AS m FROM manifest) q""",
    "manifest",
)


def admit_archive(spark, d):
    m = fx.manifest(spark, d).withColumn("mime", F.expr(MIME))
    name = F.when(F.col("ord") % 2 == 0, F.regexp_replace("filename", r"\.[^.]*$", ".ZIP")).otherwise(F.col("filename"))
    name = F.when(F.col("ord") % 11 != 4, name)
    return m.select("ord", paths.admit_archive(name, F.col("mime")).alias("reason"))


QUERIES["admit_archive"] = admit_archive
ORACLE["admit_archive"] = with_views(
    f"""SELECT ord, CASE WHEN s <> '.zip' THEN 'not a zip archive'
    WHEN m NOT IN ('', 'application/octet-stream', 'application/x-zip-compressed', 'application/zip') THEN concat('content type not allowed: ''', m, '''') END AS reason
    FROM (SELECT ord, {SUFFIX.format(f='n')} AS s, lower(coalesce({MIME}, '')) AS m FROM (
        SELECT ord, CASE WHEN ord % 11 = 4 THEN '' WHEN ord % 2 = 0 THEN regexp_replace(filename, '\\.[^.]*$', '.ZIP') ELSE filename END AS n FROM manifest) p) q""",
    "manifest",
)


def safe_member_path(spark, d):
    m = fx.manifest(spark, d)
    messy = F.when(F.col("ord") % 4 == 1, F.replace("filename", F.lit("/"), F.lit("\\"))).when(
        F.col("ord") % 4 == 2, F.concat(F.lit("./"), F.col("filename"))
    ).when(F.col("ord") % 44 == 3, F.concat(F.lit("/"), F.col("filename"))).otherwise(F.col("filename"))
    return m.select("ord", paths.safe_member_path(messy).alias("path"))


QUERIES["safe_member_path"] = safe_member_path
ORACLE["safe_member_path"] = with_views(
    """SELECT ord, CASE WHEN f = '' OR length(f) > 1024 OR starts_with(f, '/') OR list_contains(p, '..') OR contains(p[1], ':') THEN NULL ELSE array_to_string(p, '/') END AS path
    FROM (SELECT ord, f, list_filter(string_split(f, '/'), lambda x: x NOT IN ('', '.')) AS p FROM (
    SELECT ord, replace(CASE WHEN ord % 4 = 1 THEN replace(filename, '/', chr(92)) WHEN ord % 4 = 2 THEN concat('./', filename)
        WHEN ord % 44 = 3 THEN concat('/', filename) ELSE filename END, chr(92), '/') AS f FROM manifest) a) b""",
    "manifest",
)


def is_system_entry(spark, d):
    m = fx.manifest(spark, d).withColumn("name", paths.safe_member_path(F.col("filename")))
    return m.select("ord", paths.is_system_entry(F.col("name")).alias("is_system"))


QUERIES["is_system_entry"] = is_system_entry
ORACLE["is_system_entry"] = with_views("SELECT ord, sys AS is_system FROM named", "manifest", named=NAMED)


def mark_duplicate_members(spark, d):
    return adm.mark_duplicate_members(fx.manifest(spark, d)).select("archive_id", "ord", "name", "is_duplicate")


QUERIES["mark_duplicate_members"] = mark_duplicate_members
ORACLE["mark_duplicate_members"] = with_views("SELECT archive_id, ord, name, is_duplicate FROM marked", "manifest", named=NAMED, marked=MARKED)


def check_archive_structure(spark, d):
    return adm.check_archive_structure(fx.manifest(spark, d), max_members=10_000_000, max_bytes=40_000)


QUERIES["check_archive_structure"] = check_archive_structure
ORACLE["check_archive_structure"] = with_views(
    """SELECT archive_id, count(*) AS members, CAST(sum(size) AS BIGINT) AS total_bytes, arg_min(f, ord) FILTER (WHERE f IS NOT NULL) AS error FROM (
    SELECT *, CASE WHEN name IS NULL THEN 'unsafe path' WHEN is_dir THEN NULL WHEN flag_bits & 1 <> 0 THEN 'encrypted entry'
        WHEN ((external_attr >> 16) & 61440) = 40960 THEN 'symbolic link'
        WHEN sum(size) OVER (PARTITION BY archive_id ORDER BY ord) > 40000 THEN 'uncompressed size over limit' END AS f
    FROM (SELECT *, CASE WHEN is_dir THEN 0 ELSE file_size END AS size FROM named) a) b GROUP BY archive_id""",
    "manifest", named=NAMED,
)


def check_member_limits(spark, d):
    return adm.check_member_limits(fx.manifest(spark, d), max_file=3000).select("ord", "limit_error")


QUERIES["check_member_limits"] = check_member_limits
ORACLE["check_member_limits"] = with_views(
    """SELECT ord, CASE WHEN file_size <= 0 THEN 'empty' WHEN file_size > 3000 THEN 'over size limit'
    WHEN CAST(file_size AS DOUBLE) / greatest(compress_size, 1) > 100 THEN 'suspicious compression ratio' END AS limit_error FROM manifest""",
    "manifest",
)


def manifest_report(spark, d):
    return adm.manifest_report(fx.manifest(spark, d))


QUERIES["manifest_report"] = manifest_report
ORACLE["manifest_report"] = with_views("SELECT * FROM report", "manifest", **ARCHIVES)


def admit_by_budget(spark, d):
    accepted = manifest_report(spark, d).where("accepted").select("archive_id", "ord", "file_size")
    return adm.admit_by_budget(accepted, 20_000)


QUERIES["admit_by_budget"] = admit_by_budget
ORACLE["admit_by_budget"] = with_views(
    """SELECT *, running_bytes <= 20000 AS fits FROM (SELECT archive_id, ord, file_size,
    CAST(sum(file_size) OVER (PARTITION BY archive_id ORDER BY ord) AS BIGINT) AS running_bytes FROM report WHERE accepted) q""",
    "manifest", **ARCHIVES,
)

SUMMARY = """
SELECT archive_id, count(*) FILTER (WHERE accepted) AS accepted_count, count(*) FILTER (WHERE NOT accepted) AS skipped_count,
    CAST(coalesce(sum(file_size) FILTER (WHERE accepted), 0) AS BIGINT) AS accepted_size,
    CASE WHEN count(*) FILTER (WHERE accepted) = 0 THEN 'no supported videos' END AS error FROM report GROUP BY archive_id"""


def archive_summary(spark, d):
    return adm.archive_summary(manifest_report(spark, d))


QUERIES["archive_summary"] = archive_summary
ORACLE["archive_summary"] = with_views(SUMMARY, "manifest", **ARCHIVES)


def assert_summary_consistent(spark, d):
    stated = archive_summary(spark, d).withColumn(
        "accepted_size", F.col("accepted_size") + F.when(F.col("archive_id") % 6 == 2, 1).otherwise(0)
    )
    bad = adm.assert_summary_consistent(stated, manifest_report(spark, d))
    return bad.select("archive_id", "accepted_size", "row_accepted_size")


QUERIES["assert_summary_consistent"] = assert_summary_consistent
ORACLE["assert_summary_consistent"] = with_views(
    "SELECT archive_id, accepted_size + 1 AS accepted_size, accepted_size AS row_accepted_size FROM s WHERE archive_id % 6 = 2",
    "manifest", **ARCHIVES, s=SUMMARY,
)

def admit_urls(spark, d):
    pages = fx.table(spark, d, "pages")
    urls = pages.select("page_id", F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("ftp"), F.col("url"))).otherwise(F.col("url")).alias("url"))
    n = F.explode(F.array(F.col("page_id"), F.col("page_id") + 7)).alias("n")
    resolved = pages.where("page_id % 11 <> 3").select(F.try_parse_url("url", F.lit("HOST")).alias("host"), n)
    a = F.expr("CASE n % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 224 + n % 30 ELSE 8 + n % 90 END")
    b = F.expr("CASE n % 6 WHEN 1 THEN 10 + n % 30 WHEN 2 THEN 168 - n % 2 ELSE n % 200 END")
    resolved = resolved.select("host", F.concat_ws(".", a.cast("string"), b.cast("string"), (F.col("n") % 256).cast("string"), F.lit("9")).alias("address"))
    return adm.admit_urls(urls, resolved).select("page_id", "reason")


QUERIES["admit_urls"] = admit_urls
ORACLE["admit_urls"] = """
WITH r AS (SELECT host, bool_or(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a >= 224) AS internal FROM (
    SELECT host, CASE n % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 224 + n % 30 ELSE 8 + n % 90 END AS a,
        CASE n % 6 WHEN 1 THEN 10 + n % 30 WHEN 2 THEN 168 - n % 2 ELSE n % 200 END AS b
    FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, page_id + k * 7 AS n FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t
        WHERE page_id % 11 <> 3) p) q GROUP BY host)
SELECT page_id, CASE WHEN page_id % 9 = 4 OR NOT regexp_matches(url, '^https?://[^/]') THEN 'not an absolute HTTP(S) URL'
    WHEN internal IS NULL THEN 'host could not be resolved' WHEN internal THEN 'resolves to a private or reserved network' END AS reason
FROM pages LEFT JOIN r ON r.host = regexp_extract(url, '^[a-z]+://([^/:]+)', 1)"""

#: Label selections as users might send them, one per event.
RAW_CLASSES = """CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN concat('["view"," ', event_type, ' ', chr(92), 'n', chr(92), 't"]')
    WHEN 3 THEN '["view","view "]' WHEN 4 THEN concat('["', event_type, '",5]') WHEN 5 THEN '{"a":1}' WHEN 6 THEN '["click",""]'
    WHEN 7 THEN concat('["', event_type, '","zebra","ant"]') ELSE concat('["', event_type, '"') END"""
LABELS = ["view", "click", "signup", "purchase"]


def validate_class_selection(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.expr(RAW_CLASSES).alias("raw"))
    out = adm.validate_class_selection(e, "raw", LABELS)
    return out.select(
        "event_id", "class_error", F.array_join("classes", ",").alias("classes"), F.array_join("unknown", ",").alias("unknown")
    )


QUERIES["validate_class_selection"] = validate_class_selection
ORACLE["validate_class_selection"] = f"""
SELECT event_id, err AS class_error, CASE WHEN err IS NULL THEN array_to_string(names, ',') END AS classes,
    CASE WHEN err = 'unknown name' THEN array_to_string(unk, ',') END AS unknown FROM (
SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN NOT arr OR NOT texts THEN 'not a JSON array of names'
    WHEN list_contains(names, '') THEN 'empty name' WHEN len(names) <> len(list_distinct(names)) THEN 'duplicate name'
    WHEN len(unk) > 0 THEN 'unknown name' END AS err FROM (
SELECT *, list_sort(list_filter(list_distinct(names), lambda x: x NOT IN ('view', 'click', 'signup', 'purchase'))) AS unk FROM (
SELECT event_id, raw, event_id % 9 IN (1, 2, 3, 4, 6, 7) AS arr, event_id % 9 <> 4 AS texts,
    CASE event_id % 9 WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['view', event_type] WHEN 3 THEN ['view', 'view'] WHEN 6 THEN ['click', '']
        WHEN 7 THEN [event_type, 'zebra', 'ant'] END AS names
FROM (SELECT event_id, event_type, {RAW_CLASSES} AS raw FROM events) a) b) c) e"""


def effective_classes(spark, d):
    e = fx.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array("event_type")).alias("tracking_classes"),
    )
    out = adm.effective_classes(e, ["car", "person"])
    return out.select("event_id", F.array_join("effective_classes", ",").alias("classes"), "track")


QUERIES["effective_classes"] = effective_classes
ORACLE["effective_classes"] = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'car,person' WHEN 1 THEN '' ELSE event_type END AS classes, event_id % 3 <> 1 AS track FROM events"""


def class_key(spark, d):
    p = fx.table(spark, d, "part")
    messy = F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(" - ")), F.lit("-"), F.col("p_brand"), F.lit("  "))
    return p.select("p_partkey", paths.class_key(messy).alias("class_key"))


QUERIES["class_key"] = class_key
ORACLE["class_key"] = r"""
SELECT p_partkey, replace(trim(regexp_replace(replace(lower(concat(replace(p_type, ' ', ' - '), '-', p_brand)), '-', ' '), '\s+', ' ', 'g')), ' ', '_') AS class_key FROM part"""


def _vocabulary(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_type").alias("class_name"), (F.col("p_partkey") % 400).alias("class_id"))


def build_class_index(spark, d):
    good, bad = adm.build_class_index(_vocabulary(spark, d))
    return good.select("class_key", "class_id", F.lit(1).cast("bigint").alias("ids")).unionByName(
        bad.withColumn("class_id", F.lit(None).cast("bigint"))
    )


QUERIES["build_class_index"] = build_class_index
ORACLE["build_class_index"] = r"""
SELECT class_key, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS class_id, count(DISTINCT id) AS ids FROM (
    SELECT replace(trim(regexp_replace(replace(lower(p_type), '-', ' '), '\s+', ' ', 'g')), ' ', '_') AS class_key, p_partkey % 400 AS id FROM part) q GROUP BY class_key"""


def map_detector_classes(spark, d):
    dets = fx.detections(spark, d)
    # The vocabulary: labels seen in the table, one left out, numbered by their digit.
    vocab = dets.select("class_name").distinct().where("class_name <> 'Class-2'").select(
        "class_name", F.substring_index("class_name", "-", -1).cast("bigint").alias("class_id")
    )
    index, _ = adm.build_class_index(vocab)
    return adm.map_detector_classes(dets, index).select("video_id", "frame", "det_idx", "class_key", "class_id")


QUERIES["map_detector_classes"] = map_detector_classes
ORACLE["map_detector_classes"] = with_views(
    """SELECT video_id, frame, det_idx, replace(lower(class_name), '-', '_') AS class_key, CAST(right(class_name, 1) AS BIGINT) AS class_id
    FROM detections WHERE class_name <> 'Class-2'""",
    "detections",
)


def _flaw(df):
    """Damage some planned chunks so that every rule has something to find."""
    i = F.col("chunk_index") + F.col("video_id")
    return df.select(
        "video_id", "chunk_index",
        F.when(i % 11 == 3, F.col("context_end") + 1).otherwise(F.col("context_start")).alias("context_start"),
        "context_end",
        F.when(i % 7 == 2, F.col("valid_start") - 9).otherwise(F.col("valid_start")).alias("valid_start"),
        "valid_end",
        F.when(i % 5 == 1, 3).otherwise(F.col("context_end") - F.col("context_start") + 1).cast("bigint").alias("frame_count"),
        F.when(i % 13 == 4, F.col("context_end")).otherwise(F.col("context_end") + 1).alias("source_total_frames"),
    )


FLAWED = """
SELECT video_id, chunk_index, CASE WHEN i % 11 = 3 THEN context_end + 1 ELSE context_start END AS context_start, context_end,
    CASE WHEN i % 7 = 2 THEN valid_start - 9 ELSE valid_start END AS valid_start, valid_end,
    CASE WHEN i % 5 = 1 THEN 3 ELSE context_end - context_start + 1 END AS frame_count,
    CASE WHEN i % 13 = 4 THEN context_end ELSE context_end + 1 END AS source_total_frames FROM (SELECT *, chunk_index + video_id AS i FROM plan) q"""


def _listed(df, *cols):
    return df.select(*cols, F.array_join("violations", ",").alias("violations"))


def validate_chunks(spark, d):
    return _listed(val.validate_chunks(_flaw(small_plan(spark, d))), "video_id", "chunk_index")


QUERIES["validate_chunks"] = validate_chunks
ORACLE["validate_chunks"] = with_views(
    """SELECT video_id, chunk_index, concat_ws(',', CASE WHEN context_end < context_start THEN 'context_order' END,
    CASE WHEN frame_count <> context_end - context_start + 1 THEN 'frame_count' END,
    CASE WHEN context_start > valid_start OR valid_start > valid_end OR valid_end > context_end THEN 'valid_inside' END,
    CASE WHEN context_end >= source_total_frames THEN 'within_source' END) AS violations FROM flawed""",
    "videos", plan=PLAN_SQL, flawed=FLAWED,
)

#: Transitions in the union form, with defects, from the order table.
UNION_ROWS = """
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 10 THEN 'fade' WHEN 0 THEN 'hard_cut' WHEN 1 THEN 'hard_cut' WHEN 2 THEN 'hard_cut' ELSE 'gradual_transition' END AS type,
    CASE WHEN o_orderkey % 11 IN (0, 1) THEN o_orderkey % 900 END AS frame, CASE WHEN o_orderkey % 11 IN (0, 2) THEN CAST(o_orderkey % 900 AS DOUBLE) / 25 END AS ts,
    CASE WHEN o_orderkey % 11 > 2 THEN o_orderkey % 900 END AS start_frame,
    CASE WHEN o_orderkey % 11 IN (3, 4, 5, 6, 7) THEN o_orderkey % 900 + o_custkey % 5 - 1 END AS end_frame,
    CASE WHEN o_orderkey % 11 > 2 THEN CAST(o_orderkey % 900 AS DOUBLE) / 25 END AS start_ts,
    CASE WHEN o_orderkey % 11 > 3 THEN CAST(o_orderkey % 900 AS DOUBLE) / 25 END AS end_ts,
    CAST(o_custkey % 120 AS DOUBLE) / 100 AS confidence FROM orders"""


def validate_transitions(spark, d):
    rows = spark.sql(UNION_ROWS.replace("FROM orders", "FROM {orders}"), orders=fx.table(spark, d, "orders"))
    rows = rows.withColumnsRenamed({"ts": "timestamp", "start_ts": "start_timestamp", "end_ts": "end_timestamp"})
    return _listed(val.validate_transitions(rows), "o_orderkey")


QUERIES["validate_transitions"] = validate_transitions
ORACLE["validate_transitions"] = f"""
SELECT o_orderkey, concat_ws(',', CASE WHEN type = 'fade' THEN 'type' END,
    CASE WHEN type = 'hard_cut' AND (frame IS NULL OR ts IS NULL) THEN 'hard_fields' END,
    CASE WHEN type <> 'hard_cut' AND (start_frame IS NULL OR end_frame IS NULL OR start_ts IS NULL OR end_ts IS NULL) THEN 'gradual_fields' END,
    CASE WHEN type <> 'hard_cut' AND start_ts IS NOT NULL AND end_ts IS NOT NULL AND end_frame < start_frame THEN 'order' END,
    CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END) AS violations FROM ({UNION_ROWS}) q"""


def _shifted_scenes(spark, d):
    p = small_plan(spark, d)
    i = F.col("chunk_index") + F.col("video_id")
    return p.select(
        "video_id", "chunk_index",
        (F.col("valid_start") - F.when(i % 6 == 1, 1).otherwise(0)).alias("start_frame"),
        F.when(i % 9 == 5, F.col("valid_start") - 3).otherwise(F.col("valid_end")).alias("end_frame"),
    )


def validate_scenes(spark, d):
    return _listed(val.validate_scenes(_shifted_scenes(spark, d), small_plan(spark, d)), "video_id", "chunk_index")


QUERIES["validate_scenes"] = validate_scenes
ORACLE["validate_scenes"] = with_views(
    """SELECT video_id, chunk_index, concat_ws(',', CASE WHEN e < s THEN 'order' END, CASE WHEN s < valid_start OR e > valid_end THEN 'clipped' END) AS violations FROM (
    SELECT *, valid_start - CASE WHEN (chunk_index + video_id) % 6 = 1 THEN 1 ELSE 0 END AS s,
        CASE WHEN (chunk_index + video_id) % 9 = 5 THEN valid_start - 3 ELSE valid_end END AS e FROM plan) q""",
    "videos", plan=PLAN_SQL,
)


def validate_cut_ownership(spark, d):
    p = small_plan(spark, d)
    t = p.select(
        "video_id", "chunk_index",
        F.when(F.col("chunk_index") % 2 == 0, F.lit("hard_cut")).otherwise(F.lit("gradual_transition")).alias("type"),
        (F.col("valid_start") + F.col("video_id") % 4 - 2).alias("end_frame"),
    )
    return _listed(val.validate_cut_ownership(t, p), "video_id", "chunk_index")


QUERIES["validate_cut_ownership"] = validate_cut_ownership
ORACLE["validate_cut_ownership"] = with_views(
    """SELECT video_id, chunk_index, CASE WHEN e BETWEEN valid_start AND valid_end OR (chunk_index % 2 = 1 AND e = valid_start - 1) THEN '' ELSE 'ownership' END AS violations
    FROM (SELECT *, valid_start + video_id % 4 - 2 AS e FROM plan) q""",
    "videos", plan=PLAN_SQL,
)


def gate_verified(spark, d):
    jobs = fx.chunk_arrivals(spark, d).withColumn("cut_verified", F.col("event_id") % 5 != 2)
    return adm.gate_verified(jobs).select("task_id", "chunk_index")


QUERIES["gate_verified"] = gate_verified
ORACLE["gate_verified"] = with_views("SELECT task_id, chunk_index FROM chunk_arrivals WHERE event_id % 5 <> 2", "chunk_arrivals")


def validate_tracks(spark, d):
    t = fx.detections(spark, d).select(
        "video_id", (F.col("frame") - F.when(F.col("video_id") == 3, 40).otherwise(0)).alias("frame"), "det_idx",
        (F.col("det_idx") - F.when(F.col("frame") % 50 == 1, 1).otherwise(0)).alias("track_id"),
        (F.col("conf") * F.when(F.col("frame") % 40 == 2, 2).otherwise(1)).alias("confidence"),
        (F.col("x1") - F.when(F.col("frame") % 30 == 3, 8).otherwise(0)).alias("x"),
        F.col("y1").alias("y"),
        (F.col("x2") - F.col("x1") - F.when(F.col("frame") % 20 == 4, 60).otherwise(0)).alias("width"),
        (F.col("y2") - F.col("y1")).alias("height"),
        F.col("frame").alias("f"),
    )
    return _listed(val.validate_tracks(t), "video_id", "f", "det_idx")


QUERIES["validate_tracks"] = validate_tracks
ORACLE["validate_tracks"] = with_views(
    """SELECT video_id, f, det_idx, concat_ws(',', CASE WHEN f - CASE WHEN video_id = 3 THEN 40 ELSE 0 END < 0 THEN 'frame' END,
    CASE WHEN f % 50 = 1 AND det_idx = 0 THEN 'track_id' END, CASE WHEN f % 40 = 2 AND conf * 2 > 1 THEN 'confidence' END,
    CASE WHEN f % 30 = 3 AND x1 - 8 < 0 THEN 'origin' END, CASE WHEN f % 20 = 4 AND x2 - x1 - 60 <= 0 THEN 'extent' END) AS violations
    FROM (SELECT *, frame AS f FROM detections) q""",
    "detections",
)


def reject_unknown_fields(spark, d):
    e = fx.envelopes(spark, d)
    payload = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("payload", r"^\{", '{"zz":1,"extra":[],'))
    payload = payload.otherwise(F.col("payload"))
    unknown = paths.unknown_fields(payload, ["task_id", "props"])
    return e.select("event_id", F.array_join(unknown, ",").alias("unknown"), (F.size(unknown) == 0).alias("accepted"))


QUERIES["reject_unknown_fields"] = reject_unknown_fields
ORACLE["reject_unknown_fields"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra,zz' ELSE '' END AS unknown, event_id % 3 <> 0 AS accepted FROM events"


def clamp01(spark, d):
    e = fx.table(spark, d, "events")
    return e.select("event_id", boxes.clamp01(F.col("value") / 20 - 1).alias("confidence"))


QUERIES["clamp01"] = clamp01
ORACLE["clamp01"] = "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 20 - 1)) AS confidence FROM events"


def clip_boxes(spark, d):
    return boxes.clip_boxes(fx.detections(spark, d), F.lit(70), F.lit(60)).select(
        "video_id", "frame", "det_idx", "x", "y", "width", "height"
    )


QUERIES["clip_boxes"] = clip_boxes
ORACLE["clip_boxes"] = with_views(
    """SELECT video_id, frame, det_idx, least(x1, 70) AS x, least(y1, 60) AS y, least(x2, 70) - least(x1, 70) AS width, least(y2, 60) - least(y1, 60) AS height
    FROM detections WHERE x1 < 70 AND y1 < 60 AND x2 > x1 AND y2 > y1""",
    "detections",
)


def xyxy_to_cxcywh(spark, d):
    return boxes.xyxy_to_cxcywh(fx.detections(spark, d)).select("video_id", "frame", "det_idx", "cx", "cy", "w", "h")


QUERIES["xyxy_to_cxcywh"] = xyxy_to_cxcywh
ORACLE["xyxy_to_cxcywh"] = with_views(
    "SELECT video_id, frame, det_idx, x1 + (x2 - x1) / 2 AS cx, y1 + (y2 - y1) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM detections",
    "detections",
)


def confidence_filter(spark, d):
    return adm.confidence_filter(fx.detections(spark, d)).select("video_id", "frame", "det_idx", "may_emit", "may_start")


QUERIES["confidence_filter"] = confidence_filter
ORACLE["confidence_filter"] = with_views(
    """SELECT video_id, frame, det_idx, conf >= 0.5::DOUBLE AS may_emit, conf >= 0.55::DOUBLE AS may_start FROM detections WHERE conf >= 0.1::DOUBLE""",
    "detections",
)


def validate_frame_descriptor(spark, d):
    v = fx.frame_features(spark, d)
    one, three = F.lit(1).cast("bigint"), F.lit(3).cast("bigint")
    frame = F.col("frame")
    shape = F.when(frame % 5 == 0, F.array(one, F.lit(8).cast("bigint"), three)).when(
        frame % 5 == 1, F.array(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"), F.lit(8).cast("bigint"), three)
    ).otherwise(F.array(one, F.lit(8).cast("bigint"), F.lit(8).cast("bigint"), three + (frame % 2)))
    length = F.when(frame % 7 == 3, F.lit(7)).otherwise(F.size("embedding") * 3).cast("bigint")
    rows = v.select("video_id", "frame", shape.alias("shape"), length.alias("byte_length"))
    return _listed(val.validate_frame_descriptor(rows), "video_id", "frame")


QUERIES["validate_frame_descriptor"] = validate_frame_descriptor
ORACLE["validate_frame_descriptor"] = with_views(
    """SELECT CAST(video_id AS BIGINT) AS video_id, frame, concat_ws(',', CASE WHEN frame % 5 = 0 THEN 'dimensions' END, CASE WHEN frame % 5 = 1 THEN 'frames' END,
    CASE WHEN frame % 5 = 0 OR (frame % 5 > 1 AND frame % 2 = 1) THEN 'channels' END,
    CASE WHEN CASE WHEN frame % 7 = 3 THEN 7 ELSE len(embedding) * 3 END <>
        CASE WHEN frame % 5 = 0 THEN 24 WHEN frame % 5 = 1 THEN 0 ELSE 64 * (3 + frame % 2) END THEN 'bytes' END) AS violations FROM frame_features""",
    "frame_features",
)


def truncate_error(spark, d):
    t = fx.table(spark, d, "documents")
    return t.select("doc_id", paths.truncate_error(F.col("text")).alias("error"))


QUERIES["truncate_error"] = truncate_error
ORACLE["truncate_error"] = "SELECT doc_id, substring(text, 1, 2000) AS error FROM documents"


def validate_source(spark, d):
    e = fx.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 3, "ftp").when(F.col("event_id") % 2 == 0, "upload").otherwise("url").alias("kind"),
        F.when(F.col("event_id") % 3 != 0, F.lit("/in/a.mp4")).alias("upload_path"),
        F.when(F.col("event_id") % 5 < 2, F.lit("https://host/a.mp4")).when(F.col("event_id") % 5 == 2, F.lit("")).alias("url"),
    )
    return _listed(val.validate_source(e), "event_id")


QUERIES["validate_source"] = validate_source
ORACLE["validate_source"] = """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 3 THEN 'kind' END, CASE WHEN event_id % 2 = 0 AND NOT p THEN 'upload' END,
    CASE WHEN event_id % 4 = 1 AND NOT u THEN 'url' END, CASE WHEN p = u THEN 'exactly_one' END) AS violations
FROM (SELECT event_id, event_id % 3 <> 0 AS p, event_id % 5 < 2 AS u FROM events) q"""
