"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.functions.coords import duration_or, frame_count_or, parse_fps, positive
from shotspark.functions.paths import VIDEO_SUFFIXES, truncate_error
from shotspark.operators.ordered import scan
from shotspark.operators.results import PART_FRAMES


def scan_video_files(spark: SparkSession, path: str, exts: Sequence[str] = VIDEO_SUFFIXES) -> DataFrame:
    """A1: candidate files below ``path`` by suffix, in any case.

    ``content`` is not selected, so the scan lists files without reading them.
    """
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in exts]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
        .load(path)
    )
    return files.select("path", "modificationTime", "length")


# ---------------------------------------------------------------- annotations

ANNOTATION = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("transitions", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("frame_num", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    ),
)


def annotations_from_json(docs: DataFrame) -> DataFrame:
    """A3: documents ``{video: {transitions: [[s, e], ...], frame_num}}`` in ``value`` to one
    row per transition; a video without any keeps one row with NULL frames.

    ``pos`` counts from the document's ``offset``, which documents of later stretches of a video carry.
    """
    videos = docs.select(F.explode(F.from_json("value", ANNOTATION)).alias("video_id", "a"))
    rows = videos.select(
        "video_id",
        F.coalesce("a.frame_num", F.lit(0)).cast("bigint").alias("frame_num"),
        F.coalesce("a.offset", F.lit(0)).cast("int").alias("offset"),
        F.posexplode_outer("a.transitions").alias("pos", "t"),
    )
    return rows.select(
        "video_id", (F.col("pos") + F.col("offset")).alias("pos"), F.get("t", F.lit(0)).alias("start_frame"), F.get("t", F.lit(1)).alias("end_frame"), "frame_num"
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A3: annotation files; each file is one document."""
    return annotations_from_json(spark.read.text(path, wholetext=True))


def annotations_to_json(ann: DataFrame, *, part_frames: int = PART_FRAMES) -> DataFrame:
    """A4: annotation documents in ``value``, one per video and stretch of frames.

    A document covers ``part_frames`` frames of one video; readers add documents up, so a
    heavily annotated video is never gathered into one row.  Later documents say by ``offset``
    how many transitions stand in those before them.
    """
    rows = ann.withColumn("__part", F.coalesce(F.expr(f"start_frame div {part_frames}"), F.lit(0)))
    pair = F.when(F.col("start_frame").isNotNull(), F.struct("start_frame", "end_frame"))
    docs = rows.groupBy("video_id", "__part").agg(
        F.array_sort(F.collect_list(pair)).alias("pairs"), F.max("frame_num").alias("frame_num")
    )
    own = F.size("pairs").cast("bigint")
    docs = scan(docs, ["video_id"], F.col("__part").cast("bigint"), sums={"__upto": own})
    body = F.struct(
        F.transform("pairs", lambda p: F.array(p["start_frame"], p["end_frame"])).alias("transitions"),
        F.col("frame_num"),
        F.nullif(F.col("__upto") - own, F.lit(0).cast("bigint")).alias("offset"),
    )
    return docs.select(F.to_json(F.create_map(F.col("video_id").cast("string"), body)).alias("value"))


def write_annotations(ann: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A4: JSON lines that :func:`read_annotation_lines` reads back in parallel."""
    annotations_to_json(ann).write.mode(mode).text(path)


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    return annotations_from_json(spark.read.text(path))


# ---------------------------------------------------------------- probe output

_TEXT = T.StringType()
PROBE = T.StructType(
    [
        T.StructField(
            "streams",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, _TEXT)
                        for n in (
                            "width", "height", "avg_frame_rate", "r_frame_rate",
                            "nb_frames", "nb_read_frames", "duration", "codec_name",
                        )
                    ]
                )
            ),
        ),
        T.StructField("format", T.StructType([T.StructField("duration", _TEXT)])),
    ]
)


def read_probe(df: DataFrame, raw: str = "probe") -> DataFrame:
    """A5: probe JSON to video metadata; ``error`` names the first unusable field."""
    parsed = df.withColumn("__p", F.from_json(raw, PROBE)).withColumn("__s", F.get("__p.streams", F.lit(0)))
    s = "__s."
    parsed = parsed.withColumns(
        {
            "fps": parse_fps(F.col(s + "avg_frame_rate"), F.col(s + "r_frame_rate")),
            "frame_count": frame_count_or(F.col(s + "nb_frames"), F.col(s + "nb_read_frames")),
            "width": positive(F.col(s + "width"), "int"),
            "height": positive(F.col(s + "height"), "int"),
        }
    )
    error = (
        F.when(F.col("__s").isNull(), F.lit("no decodable video stream"))
        .when(F.col("width").isNull(), F.lit("width is invalid"))
        .when(F.col("height").isNull(), F.lit("height is invalid"))
        .when(F.col("fps").isNull(), F.lit("frame rate is invalid"))
        .when(F.col("frame_count").isNull(), F.lit("frame count is unknown"))
    )
    keep = [c for c in df.columns if c != raw]
    return parsed.select(
        *keep, "fps", "frame_count", "width", "height",
        duration_or(F.col(s + "duration"), F.col("__p.format.duration"), F.col("frame_count"), F.col("fps")).alias("duration_seconds"),
        F.nullif(s + "codec_name", F.lit("")).alias("codec"),
        error.alias("error"),
    )


# ---------------------------------------------------------------- results and dead letters


def results_to_json(results: DataFrame) -> DataFrame:
    """``video_id, part, document``."""
    return results.select("video_id", "part", F.to_json(F.struct("*")).alias("document"))


def write_results(results: DataFrame, path: str, *, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Result documents as JSON, in a bounded number of folders by video hash.

    One folder per video would give as many files as videos; a bucket folder still lets a
    reader of one video skip the others.
    """
    docs = results_to_json(results).withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
    # Eight writers per bucket at most: few files, and a long video's parts still spread out.
    spread = F.pmod(F.xxhash64("video_id", "part"), F.lit(8))
    docs.repartition("bucket", spread).write.mode(mode).partitionBy("bucket").json(path)


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video_id BIGINT, part BIGINT, document STRING, bucket INT").json(path)


def parse_results(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored documents back to nested rows, with ``error`` where one cannot be read.

    A document that is not JSON or has a value of another type gives a row of NULLs, the keys
    it is stored under, and the reason.
    """
    marked = T.StructType([*schema.fields, T.StructField("__raw", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw"}
    bad = F.col("r").isNull() | F.col("r.__raw").isNotNull()
    stored = [n for n in ("video_id", "part") if n in documents.columns and n in schema.names]
    fields = [
        (F.coalesce(F.when(~bad, F.col(f"r.{n}")), F.col(n)) if n in stored else F.when(~bad, F.col(f"r.{n}"))).alias(n)
        for n in schema.names
    ]
    return documents.withColumn("r", F.from_json("document", marked, options)).select(
        *fields, F.when(bad, F.lit("document does not match the schema")).alias("error")
    )


def result_state(status: DataFrame, documents: DataFrame) -> DataFrame:
    """Per task ``ready``, ``failed`` with its error, or ``pending``."""
    stored = documents.where("part = 0").select("video_id", F.lit(True).alias("__has"))
    failed = F.col("stage") == "failed"
    return status.join(stored, "video_id", "left").select(
        "video_id",
        F.when(failed, "failed").when(F.col("__has"), "ready").otherwise("pending").alias("state"),
        F.when(failed, F.coalesce("error_code", F.lit("processing_failed"))).alias("error_code"),
        F.when(failed, F.col("error_detail")).alias("error_detail"),
    )


def dead_letters(rejected: DataFrame) -> DataFrame:
    """``source_stream, source_event_id, worker, error, payload`` with the error cut."""
    return rejected.select(
        "source_stream", F.col("source_event_id").cast("string").alias("source_event_id"), "worker",
        truncate_error(F.col("error")).alias("error"), "payload",
    )


def write_dead_letters(rejected: DataFrame, path: str) -> None:
    dead_letters(rejected).write.mode("append").json(path)
