"""Literal vectors for admission, status, results, sources and delivery."""

import json

import pytest
from pyspark.sql import functions as F

from shotspark.functions import coords, paths
from shotspark.operators import admission, delivery, metrics, results, status
from shotspark.sources import files

# Literal inputs below have outcomes that the rules prescribe.


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v STRING").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "name,mime,reason",
    [
        ("a.mp4", "", None),
        ("dir.x/REAR.MKV", "video/x-matroska", None),
        ("a.mp4", "application/octet-stream", None),
        ("a.mp4", "AUDIO/mpeg", "audio only"),
        ("readme.txt", "audio/mpeg", "audio only"),
        ("readme.txt", "", "suffix not allowed: '.txt'"),
        (".mp4", "", "suffix not allowed: '<none>'"),
        ("a.", "", "suffix not allowed: '<none>'"),
        ("a.mp4", "text/plain", "content type not allowed: 'text/plain'"),
    ],
)
def test_admit_filename(spark, name, mime, reason):
    assert one(spark, name, lambda c: paths.admit_filename(c, F.lit(mime))) == reason


@pytest.mark.parametrize(
    "name,path",
    [
        ("cam/a.mp4", "cam/a.mp4"), ("cam\\a.mp4", "cam/a.mp4"), ("./cam//a.mp4", "cam/a.mp4"), ("a.b:c/x", None),
        ("../escape.mp4", None), ("a/../b", None), ("/abs.mp4", None), ("", None), ("C:/x.mp4", None), ("a/b:c", "a/b:c"), ("x" * 1025, None),
    ],
)
def test_safe_member_path(spark, name, path):
    assert one(spark, name, paths.safe_member_path) == path


def test_archive_entries(spark):
    rows = [(1, 0, "front.mp4", 3), (1, 1, "rear.MKV", 3), (1, 2, "readme.txt", 9), (1, 3, "front.mp4", 3), (1, 4, "__MACOSX/front.mp4", 1), (1, 5, "d/", 0)]
    m = spark.createDataFrame(rows, "archive_id BIGINT, ord BIGINT, filename STRING, file_size BIGINT")
    report = admission.manifest_report(m)
    assert {r.ord: r.reason for r in report.collect()} == {
        0: None, 1: None, 2: "suffix not allowed: '.txt'", 3: "repeated member", 4: "system file",
    }
    s = admission.archive_summary(report).first()
    assert (s.accepted_count, s.skipped_count, s.accepted_size, s.error) == (2, 3, 6, None)
    accepted = report.where("accepted")
    assert admission.admit_by_budget(accepted, 6).where("not fits").count() == 0
    assert admission.admit_by_budget(accepted, 5, block=1).where("not fits").count() == 1


@pytest.mark.parametrize(
    "address,internal",
    [
        ("8.8.8.8", False), ("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("127.0.0.1", True),
        ("169.254.1.1", True), ("100.64.0.1", False), ("224.0.0.1", True), ("0.0.0.0", True), ("::1", True), ("::", True), ("fe80::1", True),
        ("fd00::1", True), ("ff02::1", True), ("2001:db8::1", True), ("2606:4700::1111", False), ("2001:4860:4860::8888", False), ("nonsense", None),
    ],
)
def test_internal_address(spark, address, internal):
    assert one(spark, address, admission.is_internal_address) is internal


@pytest.mark.parametrize(
    "raw,classes,error",
    [
        (None, None, None), ("[]", [], None), ('[" car ","bus"]', ["car", "bus"], None), ("[1]", None, "not a JSON array of names"), ("car", None, "not a JSON array of names"),
        ('{"a":1}', None, "not a JSON array of names"), ('["car",""]', None, "empty name"), ('["car"," car"]', None, "duplicate name"), ('["zoo","car","ant"]', None, "unknown name"),
        ("[null]", None, "not a JSON array of names"),
    ],
)
def test_class_selection(spark, raw, classes, error):
    df = spark.createDataFrame([(raw,)], "raw STRING")
    r = admission.validate_class_selection(df, "raw", ["car", "bus"]).first()
    assert (r.classes, r.class_error, r.unknown) == (classes, error, ["ant", "zoo"] if error == "unknown name" else None)


def test_class_key(spark):
    assert one(spark, "  Anti-Aircraft -  SYSTEM ", paths.class_key) == "anti_aircraft_system"


def test_fps_and_probe(spark):
    fps = [("0/0", "30/1", 30.0), ("", "25", 25.0), ("30000/1001", None, 30000 / 1001), ("1/0", "0/0", None), ("x", "-5/1", None)]
    df = spark.createDataFrame([f[:2] for f in fps], "a STRING, r STRING").select(coords.parse_fps(F.col("a"), F.col("r")).alias("f"))
    assert [r.f for r in df.collect()] == [f[2] for f in fps]
    stream = {"width": 1280, "height": 720, "avg_frame_rate": "30000/1001", "codec_name": "h264", "nb_read_frames": "301"}
    probe = json.dumps({"streams": [stream], "format": {"duration": "10.043"}})
    r = files.read_probe(spark.createDataFrame([(1, probe)], "id BIGINT, probe STRING")).first()
    assert (r.frame_count, r.width, r.height, r.codec, r.duration_seconds, r.fps, r.error) == (301, 1280, 720, "h264", 10.043, 30000 / 1001, None)
    r = files.read_probe(spark.createDataFrame([(1, '{"streams":[]}')], "id BIGINT, probe STRING")).first()
    assert r.error == "no decodable video stream"


def test_resampling_takes_the_first_frame_at_or_after_the_tick(spark):
    v = spark.createDataFrame([(1, 5, 50, 1), (2, 3, 10, 1)], "video_id BIGINT, frame_count BIGINT, fps_num BIGINT, fps_den BIGINT")
    for piece in (2, 10_000):
        got = {}
        for r in sorted(coords.resample_index_map(v, 25, piece=piece).collect()):
            got.setdefault(r.video_id, []).append(r.frame)
        assert got == {1: [0, 2, 4], 2: [0, 1, 1, 2, 2, 2]}


def test_rescaling_rounds_halves_to_even(spark):
    ann = spark.createDataFrame([(1, 1, 2, 101), (1, 5, 6, 101), (1, 100, 103, 101), (2, 1, 2, 9)], "video_id BIGINT, start_frame BIGINT, end_frame BIGINT, frame_num BIGINT")
    v = spark.createDataFrame([(1, 60.0), (2, 0.0)], "video_id BIGINT, fps DOUBLE")
    got = sorted(map(tuple, coords.rescale_annotations(ann, v, 30.0).select("start_frame", "end_frame", "frame_num").collect()))
    assert got == [(0, 1, 50), (2, 3, 50), (49, 50, 50)]


def test_annotation_files(spark, tmp_path):
    doc = tmp_path / "a.json"
    doc.write_text(json.dumps({"v1": {"transitions": [[5, 6], [9, 20]], "frame_num": 50}, "v2": {}}))
    rows = sorted(map(tuple, files.read_annotations(spark, str(doc)).fillna(-1).collect()))
    assert rows == [("v1", 0, 5, 6, 50), ("v1", 1, 9, 20, 50), ("v2", -1, -1, -1, 0)]
    back = str(tmp_path / "out")
    files.write_annotations(files.read_annotations(spark, str(doc)), back)
    again = files.read_annotation_lines(spark, back)
    assert sorted(map(tuple, again.fillna(-1).collect())) == rows
    tiny = files.annotations_from_json(files.annotations_to_json(files.read_annotations(spark, str(doc)), part_frames=8))
    assert sorted((r.video_id, r.pos, r.start_frame, r.end_frame) for r in tiny.where("start_frame is not null").collect()) == [("v1", 0, 5, 6), ("v1", 1, 9, 20)]


def test_video_listing_is_case_insensitive(spark, tmp_path):
    for n in ("a.MP4", "b.mkv", "c.txt", "d.Webm"):
        (tmp_path / n).write_bytes(b"123")
    got = files.scan_video_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.MP4", "b.mkv", "d.Webm"]


def test_results_round_trip(spark, sf, tmp_path):
    from shotspark.catalog.results import documents

    docs = documents(spark, sf)
    files.write_results(docs, str(tmp_path / "r"), buckets=4)
    stored = files.read_result_documents(spark, str(tmp_path / "r"))
    back = files.parse_results(stored, docs.schema)
    assert back.where("error is not null").isEmpty()
    assert sorted(map(repr, back.drop("error").collect())) == sorted(map(repr, docs.collect()))
    broken = stored.limit(1).withColumn("document", F.lit('{"scenes": 5}'))
    got = files.parse_results(broken.unionByName(broken.withColumn("document", F.lit("{"))), docs.schema).collect()
    assert [(r.scenes, r.error is None, r.video_id is None) for r in got] == [(None, False, False)] * 2


def test_dead_letter_files(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "w", "e" * 3000, "{}")], "source_stream STRING, source_event_id BIGINT, worker STRING, error STRING, payload STRING")
    files.write_dead_letters(df, str(tmp_path / "d"))
    assert len(spark.read.json(str(tmp_path / "d")).first().error) == 2000


STAGES = "task_id BIGINT, seq BIGINT, stage STRING"


@pytest.mark.parametrize(
    "path,bad",
    [
        (["decoding", "cut_detection", "tracking", "aggregating", "completed"], []),
        (["decoding", "tracking"], [1]),
        (["decoding", "cut_detection", "tracking", "aggregating", "completed", "tracking"], [5]),
        (["downloading", "downloading", "failed"], []),
    ],
)
def test_stage_paths(spark, path, bad):
    u = spark.createDataFrame([(1, i, s) for i, s in enumerate(path)], STAGES)
    assert sorted(r.seq for r in status.validate_stage_path(u, block=2).where("not valid").collect()) == bad


def test_a_late_update_changes_nothing(spark):
    rows = [("decoding", 5.0, 0, 0), ("cut_detection", 8.0, 44, 0), ("tracking", 75.0, 44, 19), ("cut_detection", 30.0, 12, 3)]
    u = spark.createDataFrame(
        [(1, i, i * 1.0, s, p, f"m{i}", c, t) for i, (s, p, c, t) in enumerate(rows)],
        "task_id BIGINT, seq BIGINT, s DOUBLE, stage STRING, progress DOUBLE, message STRING, cut_completed BIGINT, tracking_completed BIGINT",
    ).withColumn("ts", F.timestamp_seconds("s"))
    for block in (1, 65_536):
        r = status.fold_status(u, block=block).first()
        assert (r.stage, r.progress, r.message, r.cut_completed, r.tracking_completed) == ("tracking", 75.0, "m2", 44, 19)


def test_merging_chunk_results(spark):
    t = spark.createDataFrame([(1, 0, "hard_cut", 100, 100, 0.8), (1, 1, "hard_cut", 100, 100, 0.95)], "video_id BIGINT, chunk_index BIGINT, type STRING, start_frame BIGINT, end_frame BIGINT, confidence DOUBLE")
    assert [r.confidence for r in results.merge_transitions(t).collect()] == [0.95]
    s = spark.createDataFrame([(1, 0, 0, 127), (1, 0, 128, 255)], "video_id BIGINT, scene_no BIGINT, start_frame BIGINT, end_frame BIGINT")
    assert tuple(results.merge_scenes(s).first()) == (1, 0, 0, 255)


def test_timings(spark):
    tasks = spark.createDataFrame([(1, 0.0, 0.1, 1.0, 50.0)], "video_id BIGINT, c DOUBLE, s DOUBLE, f DOUBLE, aggregation_ms DOUBLE").select(
        "video_id", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("f").alias("finished_at"), "aggregation_ms"
    )
    chunks = spark.createDataFrame([(1, 60.0, 40.0, 150.0), (1, 60.0, 40.0, 50.0)], "video_id BIGINT, decode_ms DOUBLE, cut_ms DOUBLE, tracking_ms DOUBLE")
    r = results.timings(tasks, chunks).first()
    assert (r.queue_wait_ms, r.decoding_ms, r.cut_detection_ms, r.tracking_ms, r.aggregation_ms, r.total_ms) == (100, 120, 80, 200, 50, 1000)
    assert r.orchestration_wait_ms == 450


def test_a_future_chunk_is_rejected(spark):
    rows = [(1, c, n * 1.0, n) for n, c in enumerate([0, 1, 2, 3, 6, 4, 3])]
    a = spark.createDataFrame(rows, "task_id BIGINT, chunk_index BIGINT, s DOUBLE, event_id BIGINT").select("task_id", "chunk_index", F.timestamp_seconds("s").alias("arrived_at"), "event_id")
    for block in (1, 2, 4_096):
        got = {r.event_id: r.outcome for r in delivery.ordered_publish(a, block=block).collect()}
        assert [got[i] for i in range(7)] == ["published"] * 4 + ["rejected", "published", "duplicate"]


def test_a_task_keeps_its_order_over_partitions(spark):
    m = spark.createDataFrame([(None if i % 5 == 4 else str(i % 3), i) for i in range(200)], "task_id STRING, event_id BIGINT")
    out = delivery.partition_by_task(m).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    for task in ("0", "1", "2"):
        ids = [r.event_id for r in out if r.partition_key == task]
        assert ids == sorted(ids)


def test_counter_reset(spark):
    rows = [("a", i * 60_000_000, i, v) for i, v in enumerate([5, 8, 2, 3, 10, 11, 11])]
    s = spark.createDataFrame(rows, "worker STRING, us BIGINT, event_id BIGINT, value BIGINT")
    for width in (300_000_000, 3_600_000_000):
        got = {r.event_id: r.increase for r in metrics.counter_increase(s, ["worker"], 300, width=width).collect()}
        assert [got[i] for i in range(7)] == [0, 3, 5, 6, 13, 14, 11]


def test_failures(spark):
    rows = [(1, 0, "other"), (1, 1, "transient"), (1, 2, "other"), (1, 3, "other"), (2, 0, "transient"), (2, 1, "terminal"), (3, 0, "other"), (3, 1, "other")]
    a = spark.createDataFrame([(*r, "cut-worker", "boom") for r in rows], "message_id BIGINT, attempt_no BIGINT, kind STRING, worker STRING, error STRING")
    got = {r.message_id: (r.route, r.attempt_no, r.task_error_code) for r in delivery.route_failures(a).collect()}
    assert got == {1: ("dead_letter", 3, "cut_worker_failed"), 2: ("dead_letter", 1, None), 3: ("pending", 1, None)}


def test_sizes_counted_at_the_source_are_those_of_the_documents(spark):
    from shotspark.operators import results as res

    videos = spark.createDataFrame([(1, 90), (2, 10)], "video_id bigint, frame_count bigint")
    scenes = spark.createDataFrame([(1, 0, 49, 0), (1, 50, 89, 1), (3, 0, 5, 0)], "video_id bigint, start_frame bigint, end_frame bigint, scene_no bigint")
    cuts = spark.createDataFrame([(1, 49, "hard_cut", 50, 0.9)], "video_id bigint, start_frame bigint, type string, end_frame bigint, confidence double")
    boxes = spark.createDataFrame(
        [(v, f, 0, f, "car", 0.9, 0.0, 0.0, 1.0, 1.0) for v, f in [(1, 1), (1, 1), (1, 60), (4, 2)]],
        "video_id bigint, frame bigint, scene_no bigint, track_id bigint, class_name string, confidence double, x double, y double, width double, height double",
    )
    timing = spark.createDataFrame([(1, 5.0)], "video_id bigint, total_ms double")
    notes = spark.createDataFrame([(1, 0, "no cut output")], "video_id bigint, chunk_index bigint, warning string")
    docs = res.document_sizes(res.assemble_results(videos, scenes, cuts, boxes, timing, notes, part_frames=40))
    direct = res.result_sizes(videos, scenes, cuts, boxes)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, docs.select(*direct.columns).collect()))


def test_cards_gather_no_entries_and_visible_boxes_are_placed_once(spark, sf):
    import __spark_entry__ as entry

    def plan(name):
        return entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()

    assert "collect_list" not in plan("outcome_totals")
    assert "Window" not in plan("visible_only")
