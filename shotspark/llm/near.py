"""Near-duplicate texts: MinHash bands, odd sketches, and exact confirmation on full sets.

Every text gets MinHash samples of its shingle set.  Bands of samples name buckets; texts
that share one are candidates.  The samples of a text are also folded into a bitmap of
parities (an odd sketch): the population count of two sketches' XOR estimates their
similarity.  A second odd sketch folds the whole set: its XOR can never count more than the
symmetric difference, so it rules pairs out with certainty.  Candidates that remain are
confirmed on their full sets.

Texts with equal content are one node.  A bucket is worked on in chunks of bounded size, and
only pairs across the components known so far are put forward, most similar first; so a group of
copies costs a few confirmations per text, not one per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.components import connected_components
from shotspark.llm.shingles import mix, shingle_set
from shotspark.llm.texts import small_batches
from shotspark.session import durable

SAMPLES, BAND, BITS = 128, 4, 1024
_draw = np.random.default_rng(905)
FACTOR = _draw.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
SHIFT = _draw.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
PLACE = _draw.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    best = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * FACTOR[None, :]
        part += SHIFT
        np.minimum(best, part.min(axis=0), out=best)
    return best


def parities(rows: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """n odd sketches: bit ``bits[i]`` of sketch ``rows[i]`` is flipped for every i."""
    flips = np.bincount(rows * BITS + bits, minlength=n * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1)


def describe(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, band hashes, and both odd sketches of each text."""
    n = len(texts)
    sizes, samples = [], np.empty((n, SAMPLES), np.uint64)
    rows, bits = [], []
    for i, text in enumerate(texts):
        own = shingle_set(text)
        sizes.append(len(own))
        samples[i] = min_hashes(own)
        rows.append(np.full(len(own), i))
        bits.append((own >> np.uint64(54)).astype(np.int64))
    whole = parities(np.concatenate(rows), np.concatenate(bits), n)
    spread = mix(samples + PLACE)
    folded = parities(np.repeat(np.arange(n), SAMPLES), (spread >> np.uint64(54)).astype(np.int64).ravel(), n)
    bands = np.zeros((n, SAMPLES // BAND), np.uint64) + np.arange(SAMPLES // BAND, dtype=np.uint64)
    for k in range(BAND):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::BAND])
    return sizes, bands.view(np.int64), folded, whole


def estimate(ones: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two folded sketches."""
    left = np.maximum(1 - 2 * ones / BITS, 1e-3)
    return 1 + BITS / (4 * SAMPLES) * np.log(left)


def put_forward(
    sizes: np.ndarray, folded: np.ndarray, whole: np.ndarray, component: np.ndarray, most: int | None,
    percent: int, margin: float, left: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a chunk to confirm: across components, not ruled out, the ``most`` likeliest per text.

    With ``left`` only pairs of a left and a right row, or of two left rows, are looked at.
    """
    f, w = folded.view(np.uint64), whole.view(np.uint64)
    a_out, b_out = [], []
    rows = np.flatnonzero(left) if left is not None else np.arange(len(sizes))
    for i in rows:
        other = component != component[i]
        if left is not None:
            other &= ~left | (np.arange(len(sizes)) > i)
        else:
            other[: i + 1] &= most is not None
        j = np.flatnonzero(other & (np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i])))
        if not len(j):
            continue
        # 100 i >= p u with i = (s - d) / 2 and u = (s + d) / 2 gives (100 + p) d <= (100 - p) s.
        differ = np.bitwise_count(w[j] ^ w[i]).sum(axis=1, dtype=np.int64)
        j = j[(100 + percent) * differ <= (100 - percent) * (sizes[j] + sizes[i])]
        if not len(j):
            continue
        guess = estimate(np.bitwise_count(f[j] ^ f[i]).sum(axis=1, dtype=np.int64))
        near = guess >= percent / 100 - margin
        j, guess = j[near], guess[near]
        if most is not None and len(j) > most:
            j = j[np.argsort(-guess, kind="stable")[:most]]
        a_out.append(np.full(len(j), i))
        b_out.append(j)
    if not a_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def _sketch_records(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record: key, content digest, set size, bands and sketches."""
    kind = records.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, digest binary, n_shingles bigint, bands array<bigint>, folded binary, whole binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            sizes, bands, folded, whole = describe(texts)
            ends = np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel())),
                    pa.array([r.tobytes() for r in folded], pa.binary()),
                    pa.array([r.tobytes() for r in whole], pa.binary()),
                ],
                names=names,
            )

    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return records.select(F.col(key), F.unhex(F.md5(content.cast("binary"))).alias("digest"), content.alias("text")).mapInArrow(sketch, schema)


PAIRS = "a bigint, b bigint"


def _pairs_in_chunks(rows: DataFrame, most: int | None, percent: int, margin: float) -> DataFrame:
    """Distinct pairs put forward by every chunk (``bucket, chunk``) of rows."""

    def propose(table: pa.Table) -> pa.Table:
        get = lambda c: table[c].to_numpy()
        bits = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(-1, BITS // 8)
        left = table["left"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        node = get("node")
        a, b = put_forward(
            get("n_shingles"), bits("folded"), bits("whole"), get("component"), most, percent, margin,
            None if left.all() else left,
        )
        first, second = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        return pa.table({"a": pa.array(first), "b": pa.array(second)})

    cols = ("bucket", "chunk", "node", "component", "left", "n_shingles", "folded", "whole")
    return rows.select(*cols).groupBy("bucket", "chunk").applyInArrow(propose, PAIRS).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.record_batch(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(check, PAIRS)


def find_near_duplicates(
    records: DataFrame, key: str = "source_event_id", text: str = "payload",
    percent: int = 75, chunk_rows: int = 512, margin: float = 0.22,
) -> DataFrame:
    """Groups of records whose texts are near-duplicates.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other ordered key and text column can be named.  Words are runs between
    ASCII white space with A-Z lower-cased; a record's set are its distinct 5-word shingles,
    with fewer words the whole sequence, and nothing for a null or blank text.  Records with
    100 * intersection >= ``percent`` * union are linked.

    Result, one row per record: the key, ``n_shingles`` (set size), ``component_id`` (smallest
    key reachable over links) and ``kept`` (key = component_id).  Empty sets link with nothing,
    each such record is its own component.  Repeated rows are copies of each other: each
    gives a row, all with the same component; a null key is never the smallest unless all are
    null, and is kept false.  Further columns are ignored.
    """
    sketched = durable(_sketch_records(records, key, text))
    nodes = durable(
        sketched.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(key).alias("least"), *(F.any_value(c).alias(c) for c in ("n_shingles", "bands", "folded", "whole"))
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # Buckets with the same members are one bucket.  Written before the join, so that adaptive
    # execution can split the members of a hot bucket.
    shared = durable(
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"))
        .filter("n > 1")
        .groupBy("n", "who")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    members = durable(banded.join(shared, "bucket"))
    sketches = nodes.select("node", "n_shingles", "folded", "whole")
    asked = durable(members.select("node").distinct())
    source = (
        records.select(F.unhex(F.md5(F.col(text).cast("string").cast("binary"))).alias("digest"), F.col(text).cast("string").alias("text"))
        .filter(F.col("text").isNotNull())
        .join(nodes.join(asked, "node").select("digest", "node"), "digest")
    )

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    first = source.groupBy("node").agg(F.any_value("text").alias("text"))
    sets = durable(first.mapInArrow(shingle, "node bigint, set binary"))

    links = None
    known = asked.withColumn("component", F.col("node"))
    for turn, most in enumerate((3, 12, None)):
        placed = members.join(known, "node")
        if turn:
            # Only buckets that still hold several components.
            mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            placed = placed.join(mixed.filter("lo <> hi").select("bucket"), "bucket")
        chunks = F.ceil(F.col("n") / chunk_rows)
        if most is not None:
            rows = placed.withColumns(
                {"chunk": F.pmod(F.xxhash64("node", F.lit(turn)), chunks), "left": F.lit(True)}
            )
        else:
            rows = _last_chunks(placed, chunk_rows)
        pairs = durable(_pairs_in_chunks(rows.join(sketches, "node"), most, percent, margin))
        fresh = durable(_confirm(pairs, sets, percent))
        if fresh.isEmpty():
            continue
        links = fresh if links is None else links.unionByName(fresh)
        known = durable(
            asked.join(connected_components(links), "node", "left").select(
                "node", F.coalesce("component", "node").alias("component")
            )
        )
    grouped = (
        nodes.select("node", "digest", "least").join(known, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = durable(grouped.join(least, "component").select("digest", "component_id"))
    return (
        sketched.select(key, "digest", "n_shingles")
        .join(of_digest.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("n_shingles") > 0), "left")
        .select(
            key, "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )


def _last_chunks(placed: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks in which every member outside its bucket's largest component meets every other one.

    The largest component of a bucket is on the right only; all other members are also left.
    Chunk (i, j) holds the left rows of part i and all rows of part j.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    marked = placed.join(largest, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    counts = marked.groupBy("bucket").agg(F.count_if("outside").alias("lefts"))
    dealt = marked.join(counts, "bucket").withColumns(
        {
            "parts": F.ceil(F.col("n") / chunk_rows), "left_parts": F.ceil(F.col("lefts") / chunk_rows),
            "own": F.xxhash64("node", F.lit(9)),
        }
    )
    i, j = F.pmod("own", "left_parts"), F.pmod("own", "parts")
    code = lambda l, r: l * F.col("parts") + r
    every = dealt.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("left_parts") - 1)))
    right = every.withColumns({"chunk": code(F.col("l"), j), "left": F.lit(False)})
    every = dealt.filter("outside").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = every.withColumns({"chunk": code(i, F.col("r")), "left": F.lit(True)})
    cols = ["bucket", "chunk", "node", "component", "left"]
    return left.select(*cols).unionByName(right.select(*cols))
