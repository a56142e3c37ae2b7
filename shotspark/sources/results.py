"""Stored result documents as a data source that opens only the folders a filter needs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Name under which sessions know the source after :func:`register_results`.
FORMAT = "video_results"


def bucket_of(video_id: int, buckets: int) -> int:
    """The folder in which ``write_results`` puts a video: Spark's 64-bit hash, modulo ``buckets``."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", video_id), seed=42)))[0] % buckets


class _File(InputPartition):
    def __init__(self, path: str, ids: frozenset[int] | None) -> None:
        super().__init__(path)
        self.path, self.ids = path, ids


class _Reader(DataSourceReader):
    def __init__(self, path: str, buckets: int) -> None:
        self.path, self.buckets, self.ids = path, buckets, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership of ``video_id`` choose folders and rows; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("video_id",):
                found = {f.value}
            elif isinstance(f, In) and f.attribute == ("video_id",):
                found = set(f.value)
            else:
                yield f
                continue
            found = frozenset(v for v in found if v is not None)
            self.ids = found if self.ids is None else self.ids & found

    def folders(self) -> list[str]:
        wanted = range(self.buckets) if self.ids is None else sorted({bucket_of(v, self.buckets) for v in self.ids})
        return [f"{self.path}/bucket={b}" for b in wanted]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for folder in self.folders():
            system, at = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
            for info in system.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
                if info.is_file and info.base_name.startswith("part-"):
                    out.append(_File(f"{folder}/{info.base_name}", self.ids))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, _File)
        path = partition.path
        system, at = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        # Compression follows the file's ending, as Spark's writer names it.
        with system.open_input_stream(at) as file:
            rest = b""
            while block := file.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from self._rows(lines, partition.ids)
            yield from self._rows([rest], partition.ids)

    @staticmethod
    def _rows(lines: list[bytes], ids: frozenset[int] | None) -> Iterator[tuple]:
        for line in lines:
            if line.strip():
                row = json.loads(line)
                if ids is None or row.get("video_id") in ids:
                    yield row.get("video_id"), row.get("part"), row.get("document")


class VideoResults(DataSource):
    """``spark.read.format("video_results").option("buckets", 256).load(path)``: documents as written by
    ``write_results``.  A filter on ``video_id`` by equality or membership opens its folders only, so one
    result costs one folder however many there are.  Files are split by folder and writer.
    ``path`` must be one that Arrow's file systems can open."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "video_id BIGINT, part BIGINT, document STRING"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("buckets", "256")))


def register_results(spark: SparkSession) -> None:
    """Make the source known to a session and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoResults)
