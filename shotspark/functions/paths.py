"""File-name rules and text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted suffixes, archive content types, system file names.
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")
ARCHIVE_TYPES = ("", "application/octet-stream", "application/x-zip-compressed", "application/zip")
SYSTEM_NAMES = (".ds_store", "desktop.ini", "thumbs.db")


def suffix(filename: Column) -> Column:
    """Lower-case last-dot suffix of the base name; empty for dotfiles and trailing dots."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def admit_filename(filename: Column, content_type: Column | None = None) -> Column:
    """B1: NULL if the file may be a video, else the reason; a missing name is an empty one."""
    mime = F.lower(F.coalesce(content_type if content_type is not None else F.lit(""), F.lit("")))
    ext = suffix(F.coalesce(filename, F.lit("")))
    return (
        F.when(F.startswith(mime, F.lit("audio/")), F.lit("audio only"))
        .when(
            ~ext.isin(*VIDEO_SUFFIXES),
            F.concat(F.lit("suffix not allowed: '"), F.when(ext == "", "<none>").otherwise(ext), F.lit("'")),
        )
        .when(
            (mime != "") & ~F.startswith(mime, F.lit("video/")) & (mime != "application/octet-stream"),
            F.concat(F.lit("content type not allowed: '"), mime, F.lit("'")),
        )
    )


def admit_archive(filename: Column, content_type: Column) -> Column:
    """B2: NULL for a ZIP upload, else the reason; a missing name is an empty one."""
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(suffix(F.coalesce(filename, F.lit(""))) != ".zip", F.lit("not a zip archive")).when(
        ~mime.isin(*ARCHIVE_TYPES), F.concat(F.lit("content type not allowed: '"), mime, F.lit("'"))
    )


def safe_member_path(name: Column, max_chars: int = 1024) -> Column:
    """The normalised path of an archive member, NULL if it is unsafe."""
    raw = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    unsafe = (
        (raw == "")
        | (F.length(raw) > max_chars)
        | F.startswith(raw, F.lit("/"))
        | F.array_contains(parts, "..")
        | F.coalesce(F.contains(F.get(parts, F.lit(0)), F.lit(":")), F.lit(False))
    )
    joined = F.array_join(parts, "/")
    return F.when(~unsafe, F.when(joined == "", ".").otherwise(joined))


def is_system_entry(path: Column) -> Column:
    """Operating-system leftovers inside an archive."""
    parts = F.split(F.lower(path), "/")
    base = F.element_at(parts, -1)
    return (F.element_at(parts, 1) == "__macosx") | base.isin(*SYSTEM_NAMES) | F.startswith(base, F.lit("._"))


def class_key(name: Column) -> Column:
    """Label spelling without case, hyphens and extra blanks."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "-", " "), r"\s+", " "))
    return F.replace(spaced, F.lit(" "), F.lit("_"))


def unknown_fields(json: Column, allowed: Sequence[str]) -> Column:
    """Top-level keys that a strict schema would refuse."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed])))


def truncate_error(detail: Column, chars: int = 2000) -> Column:
    """B31."""
    return F.substring(detail, 1, chars)


def extract_task_id(task_id: Column, payload: Column) -> Column:
    """H9: the direct field, else ``task_id`` of a JSON object payload, else NULL."""
    parsed = F.try_parse_json(payload)
    inside = F.try_variant_get(parsed, "$.task_id", "string")
    return F.coalesce(F.nullif(task_id, F.lit("")), F.nullif(inside, F.lit("")))
