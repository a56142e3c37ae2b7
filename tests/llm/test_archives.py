"""Archives: round trip, interchange with the standard ZIP reader, damaged input."""

import base64
import hashlib
import io
import zipfile

from shotspark.llm.archives import (
    DATA, archive_manifest, archive_round_trip, build_archive, central_directory, read_archive, read_records,
)

ROWS = [("1", "http://a", b"abc", None), ("2", "http://b", "é\r\n\r\nWARC/1.1".encode(), None), ("3", "x\ny", b"", "1")]


def test_other_readers_agree():
    for wide in (False, True):
        content = build_archive(iter(ROWS), wide)
        with zipfile.ZipFile(io.BytesIO(content)) as other:
            assert other.testzip() is None
            listed = central_directory(lambda a, b, c=content: c[a:b], len(content))
            assert [(m["filename"], m["file_size"], m["crc"], m["header_offset"]) for m in listed] == [
                (i.filename, i.file_size, i.CRC, i.header_offset) for i in other.infolist()
            ]


def test_reads_only_the_ranges_it_needs():
    content = build_archive(iter([(str(i), "u", bytes(5000), None) for i in range(50)]))
    asked = []

    def read(a, b):
        asked.append((a, b))
        return content[a:b]

    next(read_archive(read, len(content)))
    assert max(b - a for a, b in asked if b < len(content) - 70_000) < 6000


def test_files_and_damaged_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(build_archive(iter(ROWS), wide=True))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        z.writestr("folder/clip.mp4", "data" * 100)
        z.comment = b"a comment PK\5\6"
    (tmp_path / "c.zip").write_bytes(b"PK no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    archives = files.selectExpr("regexp_extract(path, '[^/]+$', 0) AS archive_id", "content", "path AS filename")
    archives = archives.unionByName(spark.createDataFrame([("none", None, None)], archives.schema))
    got = sorted(archive_manifest(archives).collect(), key=lambda r: (r.archive_id, r.ord or 0))
    seen = [(r.archive_id, r.ord, r.filename, r.is_dir, r.file_size, r.data_offset is not None, r.error) for r in got]
    assert [s[:4] for s in seen[:4]] == [
        ("a.zip", 0, DATA, False), ("a.zip", 1, "indexes/index.cdxj", False),
        ("b.zip", 0, "folder/", True), ("b.zip", 1, "folder/clip.mp4", False),
    ]
    assert [s[5] for s in seen] == [True, True, False, False, False, False]
    assert [bool(s[6]) for s in seen] == [False] * 4 + [True] * 2
    records = read_records(archives.filter("archive_id = 'a.zip'")).collect()
    assert [(r.id, r.payload_bytes, r.record_type, r.refers_to) for r in records] == [
        ("1", 3, "response", None), ("2", len(ROWS[1][2]), "response", None), ("3", 0, "revisit", "1"),
    ]


def test_round_trip(spark):
    html = ["one", "two", "one", None, "", "é" * 100_000, "one"]
    rows = [(i, f"u{i}", h, "c") for i, h in enumerate(html)] + [(0, "u0", "one", "c"), (None, None, "two", "c"), (None, None, "new", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")
    got = sorted((tuple(r) for r in archive_round_trip(pages).collect()), key=str)
    want = []
    for least, out in ((0, want),):
        for i, _, h, _ in rows:
            raw = (h or "").encode()
            first = min((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            revisit = first is not None and first != i and len(raw) >= least
            out.append((i, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert {r.record_type for r in archive_round_trip(pages, least_bytes=4).filter("payload_bytes < 4").collect()} == {"response"}
    assert archive_round_trip(pages.limit(0)).count() == 0
