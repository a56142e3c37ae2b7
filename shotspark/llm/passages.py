"""Long passages that occur more than once in a corpus, removed byte by byte.

In the way of prefix-free parsing, a rolling hash picks trigger places from the content
alone: of every run of gram hashes in a window of ``length`` bytes the smallest, leftmost of
equals.  So every string of that length has exactly one trigger, at the same place inside
wherever it occurs, and the windows of a text fall into phrases that share a trigger.  The
dictionary of triggers with their counts says which phrases can repeat at all; everything
else is decided for those only, from coarse to fine:

1. a phrase whose whole extent occurs again: all its windows repeat;
2. else its windows, in cells of ``CELL`` neighbouring offsets from the trigger: a cell whose
   intersection occurs once cannot repeat, one whose union occurs again repeats throughout;
3. else the windows of the cell, one by one.

Each step counts 128-bit hashes of substrings with a grouping that combines before its
shuffle.  A suffix order of all places, which the full method ends with, would sort one row
per byte; the counts decide equality without it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches
from shotspark.session import durable, scratch

GRAM, CELL = 32, 32
_draw = np.random.default_rng(4107)
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE_BITS = np.uint64((1 << 28) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every place on, by doubling."""
    h = BYTE[raw]
    step, width = 0x9E3779B97F4A7C15, 1
    while width < gram:
        h = h[:-width] * np.uint64(step) + h[width:]
        h ^= h >> np.uint64(29)
        step = (step * step + 2) % (1 << 64)
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def triggers(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger place, first and last window start of every phrase.

    Texts are shorter than 256 MB, as Spark's strings are in practice; hashes are compared by
    their upper 36 bits, then by place.
    """
    best = (grams & ~PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = window - width
    if rest:
        best = np.minimum(best[:-rest], best[rest:])
    place = (best & PLACE_BITS).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:], len(place)) - 1


def digest128(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


class Phrases:
    """The phrases of one text: trigger, window range and trigger hash."""

    def __init__(self, text: bytes, length: int, gram: int):
        grams = gram_hashes(np.frombuffer(text, np.uint8), gram)
        self.place, self.first, self.last = triggers(grams, length - gram + 1)
        self.hash = grams[self.place].view(np.int64)


def cells_of(text: bytes, place: int, first: int, last: int, length: int) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(cell, hash of its windows' intersection, hash of their union) for a phrase's cells.

    Cell ``g`` holds the windows that start ``g * CELL`` to ``g * CELL + CELL - 1`` bytes before
    the trigger; the grid depends on the trigger alone, so equal strings meet in equal cells.
    The union is null where the text does not hold all of it.
    """
    for g in range((place - last) // CELL, (place - first) // CELL + 1):
        near, far = place - g * CELL, place - g * CELL - CELL + 1
        inner = digest128(text[near : far + length])
        outer = digest128(text[far : near + length]) if far >= 0 and near + length <= len(text) else None
        yield g, inner, outer


def merge_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist(), strict=True))


class Texts:
    """Distinct long texts, written once in buckets of their digest, and joined there again and again."""

    def __init__(self, records: DataFrame, text: str, length: int, bucket_bytes: int = 24 << 20):
        self.spark = records.sparkSession
        content = F.coalesce(F.col(text).cast("string"), F.lit(""))
        long = records.select(content.alias("text")).filter(F.octet_length("text") >= length)
        size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(1, math.ceil(size / bucket_bytes))
        distinct = (
            long.groupBy(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
            .agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
            .repartition(self.buckets, "digest")
        )
        self.name = f"texts_{uuid.uuid4().hex}"
        folder = f"{scratch(self.spark)}/{self.name}"
        distinct.write.bucketBy(self.buckets, "digest").option("path", folder).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def visit(self, asked: DataFrame | None, work: Callable, schema: str) -> DataFrame:
        """``work(text, copies, asked list) -> rows`` for every text, or those that ``asked`` names.

        ``asked`` has ``digest`` and ``what``, an array of structs of integers; ``work`` yields
        tuples that follow the digest in ``schema``.
        """
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        source = self.table().select("digest", "text", "copies")
        some = asked is not None
        if some:
            source = source.join(asked, "digest")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text", 1 << 20):
                rows = []
                whats = batch.column(3) if some else [None] * batch.num_rows
                texts = batch.column(1).cast(pa.binary())
                for digest, text, copies, what in zip(batch.column(0), texts, batch.column(2), whats, strict=True):
                    given = None
                    if what is not None:
                        values = what.values
                        given = np.stack([values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)], axis=1)
                    own = digest.as_py()
                    rows += [(own, *row) for row in work(text.as_py(), copies.as_py(), given)]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return source.mapInArrow(run, schema)


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """``digest, what``: a text's own places, as many as its length allows."""
    return rows.groupBy("digest").agg(F.collect_list(F.struct(*(F.col(c).cast("long") for c in columns))).alias("what"))


def at_two_places(rows: DataFrame, content: str, place: str, wanted: str) -> DataFrame:
    """The values of ``content`` that stand at two places at least, one of them wanted.

    Cells of two triggers of a text may be the same place, so places are told apart, by hash.
    """
    at = F.xxhash64("digest", place)
    seen = rows.filter(F.col(content).isNotNull()).groupBy(content)
    return durable(
        seen.agg(F.min(at).alias("one"), F.max(at).alias("other"), F.max(wanted).alias("some"))
        .filter("one <> other and some")
        .select(content)
    )


def repeated_spans(texts: Texts, length: int, gram: int) -> DataFrame:
    """``digest, start, stop`` that together cover every byte of every repeated string."""

    def list_triggers(text: bytes, copies: int, _) -> Iterator[tuple]:
        own = Phrases(text, length, gram)
        yield from zip(own.place.tolist(), own.hash.tolist(), [copies] * len(own.place), strict=True)

    listed = durable(texts.visit(None, list_triggers, "digest binary, place bigint, trigger bigint, copies bigint"))
    # Written first, here and below: adaptive execution splits a hot key only where both sides
    # of a join come straight from a shuffle.
    dictionary = durable(listed.groupBy("trigger").agg(F.sum("copies").alias("n")).filter("n > 1").select("trigger"))
    repeating = listed.join(dictionary, "trigger").select("digest", "place")

    def extents(text: bytes, copies: int, asked: np.ndarray) -> Iterator[tuple]:
        own = Phrases(text, length, gram)
        for i in np.flatnonzero(np.isin(own.place, asked[:, 0])).tolist():
            first, last = int(own.first[i]), int(own.last[i])
            whole = digest128(text[first : last + length])
            yield int(own.place[i]), first, last, int(own.hash[i]), whole, copies

    schema = "digest binary, place bigint, first bigint, last bigint, trigger bigint, whole binary, copies bigint"
    phrases = durable(texts.visit(gathered(repeating, "place"), extents, schema))
    # One row per distinct extent: how often it occurs, and one place where it does.
    extent = durable(
        phrases.groupBy("whole", "trigger").agg(
            F.sum("copies").alias("n"), F.min(F.struct("digest", "place", "first", "last")).alias("at")
        )
    )
    again = extent.filter("n > 1").select("whole", "trigger")
    sure = phrases.join(again, ["whole", "trigger"]).select("digest", "first", (F.col("last") + length).alias("stop"))
    single = extent.filter("n = 1")
    # Where a trigger has single extents, one copy of each repeated extent may be their partner.
    open_triggers = durable(single.select("trigger").distinct())
    partners = extent.filter("n > 1").join(open_triggers, "trigger")
    asked = single.select("at.*", F.lit(1).alias("open")).unionByName(partners.select("at.*", F.lit(0).alias("open")))

    def list_cells(text: bytes, copies: int, asked: np.ndarray) -> Iterator[tuple]:
        for place, first, last, is_open in asked.tolist():
            for g, inner, outer in cells_of(text, place, first, last, length):
                lo, hi = max(first, place - g * CELL - CELL + 1), min(last, place - g * CELL)
                yield place - g * CELL, lo, hi, inner, outer, bool(is_open)

    schema = "digest binary, near bigint, lo bigint, hi bigint, inner_hash binary, outer_hash binary, open boolean"
    cells = durable(texts.visit(gathered(asked, "place", "first", "last", "open"), list_cells, schema))
    outer = at_two_places(cells, "outer_hash", "near", "open").withColumn("throughout", F.lit(True))
    mine = cells.join(at_two_places(cells, "inner_hash", "near", "open"), "inner_hash").join(outer, "outer_hash", "left")
    mine = durable(mine.withColumn("throughout", F.coalesce("throughout", F.lit(False))))
    through = mine.filter("open and throughout").select("digest", "lo", (F.col("hi") + length).alias("stop"))
    unsure = durable(mine.filter("open and not throughout").select("inner_hash").distinct())
    fine = mine.join(unsure, "inner_hash").withColumn("ask", F.col("open") & ~F.col("throughout"))

    def list_windows(text: bytes, copies: int, asked: np.ndarray) -> Iterator[tuple]:
        for lo, hi, ask in asked.tolist():
            for start in range(lo, hi + 1):
                yield start, digest128(text[start : start + length]), bool(ask)

    windows = texts.visit(gathered(fine, "lo", "hi", "ask"), list_windows, "digest binary, start bigint, own binary, ask boolean")
    windows = durable(windows)
    twice = at_two_places(windows, "own", "start", "ask")
    found = windows.filter("ask").join(twice, "own").select("digest", "start", (F.col("start") + length).alias("stop"))
    return sure.toDF("digest", "start", "stop").unionByName(through.toDF("digest", "start", "stop")).unionByName(found)


def remove_repeated_passages(
    records: DataFrame, key: str = "source_event_id", text: str = "payload", length: int = 400, gram: int = GRAM
) -> DataFrame:
    """What stays of every text once all strings of ``length`` bytes that occur again are taken out.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  Texts are UTF-8 bytes, null is
    empty; a byte goes if some string of ``length`` bytes over it also starts at another place
    of any record, the same included.  Matches lie within one text and are judged on the
    input.  Repeated rows are copies of each other: from ``length`` bytes on nothing of them
    stays.  ``gram`` is a power of two, at most ``length``.

    Result: the key, ``n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept_sha256``
    of the bytes that stay.  Further columns are ignored.
    """
    texts = Texts(records, text, length)
    spans = durable(repeated_spans(texts, length, gram))

    def strip(text: bytes, copies: int, asked: np.ndarray) -> Iterator[tuple]:
        if copies > 1:
            runs = [(0, len(text))]
        else:
            runs = merge_spans(asked[:, 0], asked[:, 1])
        kept, at = hashlib.sha256(), 0
        for start, stop in runs:
            kept.update(text[at:start])
            at = stop
        kept.update(text[at:])
        yield sum(b - a for a, b in runs), len(runs), kept.hexdigest()

    copied = texts.table().filter("copies > 1").select("digest", F.lit(0).alias("start"), F.octet_length("text").alias("stop"))
    asked = gathered(spans.unionByName(copied), "start", "stop")
    changed = durable(texts.visit(asked, strip, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string"))
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    plain = records.select(
        F.col(key), F.length(raw).cast("long").alias("n_bytes"), F.unhex(F.md5(raw)).alias("digest"), F.sha2(raw, 256).alias("plain_sha256")
    )
    return plain.join(changed, "digest", "left").select(
        key, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "plain_sha256").alias("kept_sha256"),
    )
