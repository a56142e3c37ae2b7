"""Admission of archives, URLs, label selections and detector output (B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.functions.paths import admit_filename, class_key, is_system_entry, safe_member_path
from shotspark.operators.ordered import BLOCK, scan

GIB = 1024**3
MEMBER = ["archive_id", "ord"]


def is_directory() -> Column:
    return F.endswith(F.col("filename"), F.lit("/"))


def mark_duplicate_members(manifest: DataFrame) -> DataFrame:
    """``is_duplicate`` for the later occurrences of a normalised name in an archive.

    The first occurrence is a grouped minimum; members find out by an equi-join that also
    has the member's own position as key, so a name that fills half an archive spreads out.
    """
    named = manifest.withColumn("name", safe_member_path(F.col("filename")))
    counted = named.where(~is_directory() & F.col("name").isNotNull() & ~is_system_entry(F.col("name")))
    firsts = counted.groupBy("archive_id", "name").agg(F.min("ord").alias("ord")).withColumn("__first", F.lit(True))
    eligible = ~is_directory() & F.col("name").isNotNull() & ~is_system_entry(F.col("name"))
    return (
        named.join(firsts, ["archive_id", "name", "ord"], "left")
        .withColumn("is_duplicate", F.coalesce(eligible, F.lit(False)) & F.col("__first").isNull())
        .select(*manifest.columns, "name", "is_duplicate")
    )


def check_archive_structure(
    manifest: DataFrame, max_members: int = 2000, max_bytes: int = 8 * GIB, *, block: int = BLOCK
) -> DataFrame:
    """Per archive the member count, the byte total and the first fatal finding.

    Findings are ranked by member order; the byte limit trips at the member whose running
    total first exceeds it.
    """
    files = ~is_directory()
    size = F.when(files, F.col("file_size")).otherwise(0)
    rows = scan(manifest, ["archive_id"], F.col("ord"), width=block, sums={"running": size})
    finding = (
        F.when(safe_member_path(F.col("filename")).isNull(), F.lit("unsafe path"))
        .when(files & (F.col("flag_bits").bitwiseAND(F.lit(1)) != 0), F.lit("encrypted entry"))
        .when(
            files & (F.shiftright(F.col("external_attr").cast("bigint"), 16).bitwiseAND(F.lit(0xF000)) == 0xA000),
            F.lit("symbolic link"),
        )
        .when(files & (F.col("running") > max_bytes), F.lit("uncompressed size over limit"))
    )
    return (
        rows.withColumn("__f", finding)
        .groupBy("archive_id")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum(size).alias("total_bytes"),
            F.min(F.when(F.col("__f").isNotNull(), F.struct("ord", F.col("__f").alias("f")))).alias("__first"),
        )
        .select(
            "archive_id", "members", "total_bytes",
            F.when(F.col("members") > max_members, F.lit("too many entries")).otherwise(F.col("__first.f")).alias("error"),
        )
    )


def check_member_limits(manifest: DataFrame, max_file: int = 4 * GIB, max_ratio: float = 100.0) -> DataFrame:
    """``limit_error`` of a single member, NULL if none."""
    ratio = F.col("file_size").cast("double") / F.greatest(F.col("compress_size"), F.lit(1)).cast("double")
    return manifest.withColumn(
        "limit_error",
        F.when(F.col("file_size") <= 0, F.lit("empty"))
        .when(F.col("file_size") > max_file, F.lit("over size limit"))
        .when(ratio > max_ratio, F.lit("suspicious compression ratio")),
    )


def admit_by_budget(accepted: DataFrame, max_bytes: int = 4 * GIB, *, block: int = BLOCK) -> DataFrame:
    """Running byte total in archive order and whether it still fits."""
    rows = scan(accepted, ["archive_id"], F.col("ord"), width=block, sums={"running_bytes": F.col("file_size")})
    return rows.withColumn("fits", F.col("running_bytes") <= max_bytes)


def manifest_report(manifest: DataFrame) -> DataFrame:
    """Every file of every archive with its verdict and the first reason that applies."""
    marked = mark_duplicate_members(manifest).where(~is_directory())
    reason = F.coalesce(
        F.when(F.col("name").isNull(), F.lit("unsafe member path")),
        F.when(is_system_entry(F.col("name")), F.lit("system file")),
        F.when(F.col("is_duplicate"), F.lit("repeated member")),
        admit_filename(F.col("name")),
    )
    return marked.select(
        *MEMBER, "filename", "name", "file_size", reason.alias("reason"), reason.isNull().alias("accepted")
    )


def archive_summary(report: DataFrame) -> DataFrame:
    """B11."""
    return report.groupBy("archive_id").agg(
        F.count_if("accepted").alias("accepted_count"),
        F.count_if(~F.col("accepted")).alias("skipped_count"),
        F.sum(F.when(F.col("accepted"), F.col("file_size")).otherwise(0)).alias("accepted_size"),
    ).withColumn("error", F.when(F.col("accepted_count") == 0, F.lit("no supported videos")))


def assert_summary_consistent(summary: DataFrame, report: DataFrame) -> DataFrame:
    """The archives whose summary disagrees with its rows (empty when consistent)."""
    recount = archive_summary(report).select(
        "archive_id",
        *[F.col(c).alias(f"row_{c}") for c in ("accepted_count", "skipped_count", "accepted_size")],
    )
    both = summary.join(recount, "archive_id", "full_outer")
    same = F.lit(True)
    for c in ("accepted_count", "skipped_count", "accepted_size"):
        same = same & F.col(c).eqNullSafe(F.col(f"row_{c}"))
    return both.where(~same)


# IPv4 networks that are private, loopback, link-local, multicast, reserved
# or unspecified, as (first address, last address).
INTERNAL_IPV4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)


def _ipv4(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def is_internal_address(address: Column) -> Column:
    """True for addresses no public URL may resolve to; NULL if it is no address.

    IPv6: only 2000::/3 is public, minus the special-purpose blocks inside it.
    """
    octets = F.transform(F.split(address, r"\."), lambda p: p.try_cast("bigint"))
    is_v4 = F.regexp_like(address, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    v4 = F.lit(False)
    for first, last in INTERNAL_IPV4:
        v4 = v4 | number.between(_ipv4(first), _ipv4(last))
    groups = F.split(address, ":")

    def hextet(i: int) -> Column:
        return F.coalesce(F.conv(F.nullif(F.get(groups, F.lit(i)), F.lit("")), 16, 10).cast("bigint"), F.lit(0))

    h0, h1 = hextet(0), hextet(1)
    v6 = (
        ~h0.between(0x2000, 0x3FFF)
        | ((h0 == 0x2001) & (h1 < 0x200) & (h1 != 3) & ~h1.between(0x20, 0x3F))
        | ((h0 == 0x2001) & (h1 == 0xDB8))
        | (h0 == 0x2002)
        | ((h0 == 0x3FFF) & (h1 < 0x1000))
    )
    return F.when(is_v4, v4).when(F.contains(address, F.lit(":")), v6)


def admit_urls(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each URL with a reason, NULL if it may be fetched.

    ``resolved(host, address)`` holds every address of a host; one internal address is
    enough to refuse it.  Addresses are reduced to one row per host before the join.
    """
    parsed = urls.withColumn("__scheme", F.lower(F.try_parse_url("url", F.lit("PROTOCOL")))).withColumn(
        "host", F.lower(F.try_parse_url("url", F.lit("HOST")))
    )
    hosts = resolved.groupBy(F.lower("host").alias("host")).agg(
        F.bool_or(F.coalesce(is_internal_address(F.col("address")), F.lit(True))).alias("__internal")
    )
    reason = (
        F.when(
            F.col("__scheme").isNull() | ~F.col("__scheme").isin("http", "https") | F.coalesce(F.col("host") == "", F.lit(True)),
            F.lit("not an absolute HTTP(S) URL"),
        )
        .when(F.col("__internal").isNull(), F.lit("host could not be resolved"))
        .when(F.col("__internal"), F.lit("resolves to a private or reserved network"))
    )
    return parsed.join(hosts, "host", "left").select(*urls.columns, reason.alias("reason"))


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def validate_class_selection(df: DataFrame, raw: str, vocab: Sequence[str]) -> DataFrame:
    """Parse a JSON label list; adds ``classes``, ``class_error`` and ``unknown``.

    NULL means "not given" and stays NULL without an error.
    """
    parsed = F.try_variant_get(F.try_parse_json(F.col(raw)), "$", "array<variant>")
    df = df.withColumn("__items", parsed)
    # try_variant_get would turn a number into text, so the element type is checked too.
    only_text = F.forall("__items", lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    names = F.transform("__items", lambda v: _strip(F.try_variant_get(v, "$", "string")))
    df = df.withColumn("__text", only_text).withColumn("__names", F.when(F.col("__text"), names))
    unknown = F.array_sort(F.array_except(F.col("__names"), F.array(*[F.lit(v) for v in vocab])))
    error = (
        F.when(F.col(raw).isNull(), F.lit(None).cast("string"))
        .when(F.col("__items").isNull() | ~F.col("__text"), F.lit("not a JSON array of names"))
        .when(F.exists("__names", lambda n: n == ""), F.lit("empty name"))
        .when(F.size("__names") != F.size(F.array_distinct("__names")), F.lit("duplicate name"))
        .when(F.size(unknown) > 0, F.lit("unknown name"))
    )
    df = df.withColumn("class_error", error)
    return df.withColumns(
        {
            "classes": F.when(F.col("class_error").isNull(), F.col("__names")),
            "unknown": F.when(F.col("class_error") == "unknown name", unknown),
        }
    ).drop("__items", "__text", "__names")


def effective_classes(tasks: DataFrame, default: Sequence[str]) -> DataFrame:
    """NULL selects the default list, an empty list means "do not track"."""
    classes = F.coalesce("tracking_classes", F.array(*[F.lit(c) for c in default]))
    return tasks.withColumns({"effective_classes": classes, "track": F.size(classes) > 0})


def build_class_index(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class_key, class_id)`` and, separately, keys claimed by several ids."""
    keyed = vocab.select(class_key(F.col("class_name")).alias("class_key"), "class_id")
    counts = keyed.groupBy("class_key").agg(
        F.min("class_id").alias("class_id"), F.count_distinct("class_id").alias("ids")
    )
    return counts.where("ids = 1").drop("ids"), counts.where("ids > 1").select("class_key", "ids")


def map_detector_classes(dets: DataFrame, index: DataFrame) -> DataFrame:
    """Detector label to output id by key; labels outside the vocabulary drop out.

    The index is a dimension table; Spark broadcasts it when its size allows.
    """
    return dets.withColumn("class_key", class_key(F.col("class_name"))).join(index, "class_key")


def confidence_filter(dets: DataFrame, emit: float = 0.5, low: float = 0.1, new: float = 0.55) -> DataFrame:
    """Drop boxes under the candidate floor, mark what may be emitted or start a track."""
    return dets.where(F.col("conf") >= min(low, emit)).withColumns(
        {"may_emit": F.col("conf") >= emit, "may_start": F.col("conf") >= max(new, emit)}
    )


def gate_verified(jobs: DataFrame) -> DataFrame:
    """B23."""
    return jobs.where("cut_verified")
