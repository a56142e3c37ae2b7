"""Registered queries ``opN_<name>``: thin steps between the given tables and the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm import (
    alignment,
    archives,
    html,
    languages,
    leaks,
    licences,
    loops,
    near,
    neighbours,
    packing,
    passages,
    personal,
    quality,
    tokens,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a frame of one video, ``embeddings``; every twentieth asks."""
    frames = table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("video_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("feature")
    )
    found = neighbours.nearest_frames(frames, frames.filter(F.col("frame") % 20 == 0), k=20, factor=FACTOR)
    return found.select(
        F.col("frame").alias("query_id"), "rank", F.col("match_frame").alias("vec_id"), "score"
    )


def op2_pack_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a video, a token a frame."""
    return packed(table(spark, sf_dir, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    scenes = tokens.scenes_of_texts(
        documents.select(F.col("doc_id").alias("key"), "text"), public_tokenizers.path(VOCABULARY), END_ID
    )
    return packing.pack_scenes(scenes).select(
        F.col("key").alias("doc_id"), F.col("start_frame").alias("start"),
        (F.col("end_frame") - F.col("start_frame") + 1).alias("length"), "ids_crc32", "doc_tokens",
        F.col("window_id").alias("sequence_id"), F.col("window_offset").alias("offset"),
    )


def held_out() -> Column:
    """Whether a document's label stays unseen while learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality")
    scored = quality.score_payloads(table(spark, sf_dir, "documents"), labels, key="doc_id", text="text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op5_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it contains."""
    return leaks.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), key="doc_id", text="text"
    )


def op6_scan_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def op7_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated_passages(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def op8_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.find_near_duplicates(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def op10_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(table(spark, sf_dir, "documents"), key="doc_id", text="text")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.withColumn("base", base).select(
        "doc_id", *(number(kind).alias(f"n_{kind}") for kind in personal.BASE),
        F.sha2(personal.spelt(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal.spelt(F.col("spans")).alias("spans"),
    )


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = alignment.align_payloads(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES),
        key="doc_id", text="text", digest=True,
    )
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.identify_languages(
        table(spark, sf_dir, "documents"), key="doc_id", text="text", language="lang", learn=~held_out()
    )
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op13_find_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a video, a word the label of a frame; a tenth of the documents is made to loop."""
    found = loops.find_loops(
        table(spark, sf_dir, "documents").select("doc_id", looped().alias("words")), key="doc_id", labels="words"
    )
    spelt = F.transform("loops", lambda r: F.concat_ws(",", r["start_frame"], r["length"], r["period"]))
    longest = F.array_min(
        F.transform("loops", lambda r: F.struct((-r["length"]).alias("less"), r["start_frame"].alias("start"), r["period"].alias("period")))
    )
    length, period = -F.col("longest.less"), F.col("longest.period")
    text = F.array_join(F.transform(spelt, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("loops").cast("long").alias("n_runs"), F.col("longest.start").alias("start"),
        length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("once").cast("binary"), 256).alias("collapsed_sha256"),
    )


def looped() -> Column:
    """The text; where the id's checksum ends in 0, its words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(F.col("text"))


#: Pruning of op1: 1 is exact search.
FACTOR = 2.0
#: Vocabulary of op2 and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: The two vocabularies of op11.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES = {
    "op1_nearest_frames": op1_nearest_frames,
    "op2_pack_scenes": op2_pack_scenes,
    "op3_score_quality": op3_score_quality,
    "op4_main_text": op4_main_text,
    "op5_find_leaks": op5_find_leaks,
    "op6_scan_licences": op6_scan_licences,
    "op7_remove_passages": op7_remove_passages,
    "op8_archive_pages": op8_archive_pages,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_find_personal_data": op10_find_personal_data,
    "op11_align_tokens": op11_align_tokens,
    "op12_identify_languages": op12_identify_languages,
    "op13_find_loops": op13_find_loops,
}
#: Base32 letters come from the hexadecimal digest, four for every five digits.
ORACLE: dict[str, str] = {
    "op8_archive_pages": """
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
    list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(concat('0x', substr(d, 5 * g + 1, 5)) AS BIGINT) >> (15 - 5 * k)) & 31 AS BIGINT), 1)),
        'string_agg', '')), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, h, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM (
    SELECT page_id, coalesce(html, '') AS h FROM pages) a) b""",
}
