"""Web records in ZIP archives: written as WARC files with an index, read in place.

An archive holds ``archive/data.warc`` and ``indexes/index.cdxj``, both stored without
compression, so that a record is a byte range of the archive itself.  The reader starts from
the end record, follows the central directory (and its ZIP64 form), finds where a stored
member's bytes begin, reads the index and from it single records; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches
from shotspark.session import durable

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
WIDE = 0xFFFFFFFF
RECORD_ID = "urn:shotspark:page:"
#: One date for all records: the data model keeps no time of capture.
DATE = "2024-01-01T00:00:00Z"

#: bytes start, stop -> those bytes
ReadRange = Callable[[int, int], bytes]


def zip_stored(members: list[tuple[str, bytes]], wide: bool = False) -> bytes:
    """A ZIP archive of stored members; ``wide`` writes ZIP64 fields whether needed or not."""
    out, directory = bytearray(), bytearray()
    for name, content in members:
        raw, crc, size, at = name.encode(), zlib.crc32(content), len(content), len(out)
        big = wide or size >= WIDE or at >= WIDE
        version, short = (45, WIDE) if big else (20, size)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", version, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra))
        out += raw + extra + content
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        directory += struct.pack(
            "<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, version, 0x800, 0, 0, 0x21, crc, short, short,
            len(raw), len(extra), 0, 0, 0, 0, WIDE if big else at,
        ) + raw + extra
    start, count = len(out), len(members)
    out += directory
    if wide or start >= WIDE or count >= 0xFFFF:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(directory), start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, WIDE, WIDE, 0)
    else:
        out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, len(directory), start, 0)
    return bytes(out)


def central_directory(read: ReadRange, length: int) -> list[dict]:
    """The members an archive lists, in order; ``ValueError`` where there is no end record.

    Each has the manifest fields filename, is_dir, flag_bits, external_attr, file_size,
    compress_size, and method, crc and header_offset.
    """
    tail_from = max(0, length - 65_557)
    tail = read(tail_from, length)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<10xHII", tail, at)
    if count == 0xFFFF or size == WIDE or start == WIDE:
        locator_at = tail_from + at - 20
        locator = read(max(0, locator_at), locator_at + 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<8xQ", locator)
        record = read(end64, end64 + 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<32xQQQ", record)
    raw = read(start, start + size)
    members, at = [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2" or len(raw) < at + 46:
            raise ValueError("damaged central directory")
        flags, method, crc, packed, plain, n, m, k, attributes, offset = struct.unpack_from("<8xHH4xIIIHHH4xII", raw, at)
        name, extra = raw[at + 46 : at + 46 + n], raw[at + 46 + n : at + 46 + n + m]
        wide = {}
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            wide.setdefault(kind, extra[4 : 4 + long])
            extra = extra[4 + long :]
        values = [v for (v,) in struct.iter_unpack("<Q", wide.get(1, b"")[: len(wide.get(1, b"")) // 8 * 8])]
        plain = values.pop(0) if plain == WIDE and values else plain
        packed = values.pop(0) if packed == WIDE and values else packed
        offset = values.pop(0) if offset == WIDE and values else offset
        filename = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        members.append(
            {"filename": filename, "is_dir": filename.endswith("/"), "flag_bits": flags, "external_attr": attributes,
             "file_size": plain, "compress_size": packed, "method": method, "crc": crc, "header_offset": offset}
        )
        at += 46 + n + m + k
    return members


def member_range(read: ReadRange, member: dict) -> tuple[int, int]:
    """Where a stored member's bytes lie in the archive."""
    if member["method"] != 0 or member["flag_bits"] & 1:
        raise ValueError(f"{member['filename']} is not stored plainly")
    at = member["header_offset"]
    header = read(at, at + 30)
    if header[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {member['filename']}")
    n, m = struct.unpack_from("<26xHH", header)
    start = at + 30 + n + m
    return start, start + member["file_size"]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(number: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record without the payload but with its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_ID}{number}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{RECORD_ID}{refers_to}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower case), HTTP fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in http.decode("utf-8", "replace").split("\r\n")[1:])
    return {"fields": fields, "http": {k.strip().lower(): v.strip() for k, _, v in pairs}, "payload": payload}


def build_archive(rows: Iterator[tuple[str, str, bytes, str | None]], wide: bool = False) -> bytes:
    """(number, url, payload, refers_to) rows as one archive with its index."""
    data, index = bytearray(), []
    for number, url, payload, refers_to in rows:
        record = warc_record(number, url, payload, refers_to)
        entry = {"url": url, "id": number, "offset": len(data), "length": len(record)}
        index.append(json.dumps(entry))
        data += record
    return zip_stored([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())], wide)


def read_archive(read: ReadRange, length: int) -> Iterator[dict]:
    """All records of an archive through its index, each by one range read."""
    members = {m["filename"]: m for m in central_directory(read, length)}
    data, _ = member_range(read, members[DATA])
    listing = read(*member_range(read, members[INDEX]))
    for line in listing.decode().split("\n"):
        if line:
            entry = json.loads(line)
            at = data + entry["offset"]
            yield parse_record(read(at, at + entry["length"])) | {"id": entry["id"]}


def archive_manifest(archives: DataFrame) -> DataFrame:
    """The members of every archive (``archive_id STRING, content BINARY``), as manifest rows.

    ``archive_id, ord, filename, is_dir, flag_bits, external_attr, file_size, compress_size,
    data_offset`` (null unless stored plainly) and ``error``; an archive that cannot be read
    gives one row with the reason, a null content counts as empty.
    """
    schema = (
        "archive_id string, ord bigint, filename string, is_dir boolean, flag_bits bigint, external_attr bigint, "
        "file_size bigint, compress_size bigint, data_offset bigint, error string"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            rows = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer() or b"") if content.is_valid else memoryview(b"")
                read = lambda a, b, v=view: bytes(v[a:b])
                try:
                    for number, member in enumerate(central_directory(read, len(view))):
                        try:
                            at = member_range(read, member)[0]
                        except ValueError:
                            at = None
                        rows.append((archive, number, *(member[c] for c in names[2:8]), at, None))
                except (ValueError, struct.error) as reason:
                    rows.append((archive, *[None] * 8, str(reason)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 5, pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return archives.select("archive_id", "content").mapInArrow(list_members, schema)


def first_holders(pages: DataFrame, key: str, page: str, least_bytes: int) -> DataFrame:
    """``digest, holder``: the smallest key of every payload of at least ``least_bytes`` bytes."""
    payload = F.coalesce(F.col(page).cast("string"), F.lit("")).cast("binary")
    held = pages.select(F.col(key).alias("holder"), payload.alias("payload")).filter(F.length("payload") >= least_bytes)
    return held.groupBy(F.sha1("payload").alias("digest")).agg(F.min("holder").alias("holder"))


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html",
    least_bytes: int = 0, archive_bytes: int = 4 << 20,
) -> DataFrame:
    """Every page as a WARC record in archives of about ``archive_bytes``: ``archive_id, content``.

    Archives are rows of a written table, each small enough for one task, so that any store
    Spark can write will hold them; ``content`` is the bytes of a ZIP file.
    """
    holders = durable(first_holders(pages, key, page, least_bytes))
    payload = F.coalesce(F.col(page).cast("string"), F.lit(""))
    kept = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    # Equal payloads may be a third of all pages: only long enough ones look for their holder,
    # and adaptive execution splits the side of the pages.
    marked = kept.withColumn("own", F.sha1(F.col("payload").cast("binary"))).join(
        holders.withColumnRenamed("digest", "own"), "own", "left"
    )
    refers: Column = F.when((F.col("key") == F.col("holder")) | F.col("holder").isNull(), F.lit(None)).otherwise(F.col("holder"))
    rows = marked.select(F.col("key").cast("string"), "url", "payload", refers.cast("string").alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "payload", archive_bytes):
            numbers = [k or "" for k in batch.column(0).to_pylist()]
            payloads = (p.as_py() for p in batch.column(2).cast(pa.binary()))
            content = build_archive(zip(numbers, batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), strict=True))
            name = hashlib.sha1(content).hexdigest()
            yield pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], names=["archive_id", "content"])

    return durable(rows.mapInArrow(pack, "archive_id string, content binary"))


RECORDS = "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def read_records(archives: DataFrame) -> DataFrame:
    """Every WARC record of archives (``content BINARY``, as binary files or as written above).

    Payloads of response records are measured and digested anew; a digest that differs from
    the record's own ends the job.  A revisit's length and digest are those it names.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            rows = []
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                for record in read_archive(lambda a, b, v=view: bytes(v[a:b]), len(view)):
                    fields = record["fields"]
                    named = fields["warc-payload-digest"].removeprefix("sha1:")
                    size, refers = int(record["http"]["content-length"]), fields.get("warc-refers-to")
                    if fields["warc-type"] == "response":
                        size = len(record["payload"])
                        if payload_digest(record["payload"]) != named:
                            raise ValueError(f"record {record['id']} does not match its digest")
                    refers = refers and refers.strip("<>").removeprefix(RECORD_ID)
                    rows.append((record["id"], fields["warc-target-uri"], size, named, fields["warc-type"], refers))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(look, RECORDS)


def archive_round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Write a WARC record per page into ZIP archives and read all records back.

    The project's archives are ZIP files of uploads; here their members are web records.
    ``pages`` has a key, an address and a page (null: empty, address too); further columns are
    ignored.  Of records with equal payloads of at least ``least_bytes`` bytes that with the
    smallest key is a response and the others revisit it; smaller ones are all responses.
    Repeated rows of the smallest key are all responses; with null keys only, so are all.

    Result: the key, ``payload_bytes, payload_digest, record_type, refers_to``.
    """
    kind = pages.schema[key].dataType.simpleString()
    records = read_records(write_archives(pages, key, url, page, least_bytes))
    number = F.when(F.col("id") != "", F.col("id").cast(kind))
    return records.select(
        number.alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
