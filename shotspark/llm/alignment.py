"""Alignment of two cuttings of the same range: scenes of two detectors, tokens of two vocabularies.

Both cuttings cover the same positions (frames, bytes).  Where ends coincide the range is cut
into groups, found by divide and conquer: :func:`shared_groups` looks for a common end near the
middle of an interval by bisection, cuts there and goes on with both halves; an interval
without one is a group.  All intervals of a batch are halved together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches
from shotspark.llm.tokens import _byte_letters
from shotspark.session import durable

#: Fixed value: how the byte-level vocabulary cuts a text before it merges.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Codes of id pairs: the first vocabulary's id times this, plus the second's.
PAIR = 1 << 24


# ---------------------------------------------------------------- divide and conquer


def _windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the non-empty ranges ``low .. high - 1``, and where each range begins."""
    size = high - low
    first = np.cumsum(size) - size
    return np.repeat(low - first, size) + np.arange(int(size.sum())), first


def _middle_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per interval the index in ``low .. high - 2`` of ``ends_a`` that ``ends_b`` shares and
    that is nearest to the middle, -1 if there is none.

    Each round bisects ``ends_b`` for the ends around the middle; where none of them is
    shared, the next round looks twice as far.
    """
    cut = np.full(len(low), -1)
    middle = (low + high - 2) // 2
    waiting, reach = np.flatnonzero(high - low > 1), 0
    while len(waiting):
        m, a, z = middle[waiting], low[waiting], high[waiting] - 1
        left, right = np.maximum(a, m - reach), np.minimum(z, m + reach + 1)
        tried, first = _windows(left, right)
        ends = ends_a[tried]
        shared = ends_b[np.searchsorted(ends_b, ends)] == ends
        off = tried - np.repeat(m, right - left)
        # Nearest first, the one before the middle first among equals.
        order = np.where(shared, 2 * np.abs(off) + (off > 0), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(order, first)
        hit = best < np.iinfo(np.int64).max
        far = best[hit] // 2
        cut[waiting[hit]] = m[hit] + np.where(best[hit] % 2 == 1, far, -far)
        waiting = waiting[~hit & ((left > a) | (right < z))]
        reach = 2 * reach + 1
    return cut


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Indexes into ``ends_a`` at which a group ends, ascending.

    Both arrays ascend strictly and share the ends of ``roots``, indexes into ``ends_a`` of
    the last ends of independent ranges (texts, videos).
    """
    found = [roots]
    high = roots + 1
    low = np.concatenate([[0], high])[: len(high)]
    while len(low):
        cut = _middle_cuts(ends_a, ends_b, low, high)
        halved = cut >= 0
        low, high, cut = low[halved], high[halved], cut[halved]
        found.append(cut)
        # In order, so that neighbouring intervals bisect neighbouring places.
        low, high = np.stack([low, cut + 1], 1).ravel(), np.stack([cut + 1, high], 1).ravel()
    return np.sort(np.concatenate(found))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of parts that overlap: one pair for every stretch between two ends."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def align_scenes(videos: DataFrame) -> DataFrame:
    """Groups of scenes that two detectors end alike: ``video_id, scenes_a, scenes_b``, one row a group.

    ``videos`` has ``video_id, ends_a ARRAY<BIGINT>, ends_b ARRAY<BIGINT>``: the last frame of
    every scene by each detector, ascending, both with the last frame of the video.  A group
    lists the scene numbers (from 0) of both.  Null or empty arrays, arrays with nulls, arrays
    that do not ascend or end differently give no rows; null ids and repeated rows are kept,
    and further columns are ignored.
    """
    kind = videos.schema["video_id"].dataType.simpleString()
    schema = f"video_id {kind}, scenes_a array<bigint>, scenes_b array<bigint>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts = [], ([], [])
            for row, (a, b) in enumerate(zip(batch["ends_a"].to_pylist(), batch["ends_b"].to_pylist(), strict=True)):
                if not a or not b or None in a or None in b or a[-1] != b[-1]:
                    continue
                ea, eb = np.array(a, np.int64), np.array(b, np.int64)
                if (np.diff(ea) <= 0).any() or (np.diff(eb) <= 0).any():
                    continue
                last = shared_groups(ea, eb, np.array([len(ea) - 1]))
                to_b = np.searchsorted(eb, ea[last])
                for own, ends in ((parts[0], last), (parts[1], to_b)):
                    own += [list(range(s, e)) for s, e in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist(), strict=True)]
                owner += [row] * len(last)
            kinds = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch["video_id"].take(pa.array(owner, pa.int64())), pa.array(parts[0], kinds), pa.array(parts[1], kinds)],
                names=["video_id", "scenes_a", "scenes_b"],
            )

    return videos.select("video_id", "ends_a", "ends_b").mapInArrow(align, schema)


# ---------------------------------------------------------------- the two vocabularies


class Vocabularies:
    """Ids of texts by both vocabularies, with the byte lengths of all ids.

    The first is a byte-level merge vocabulary (JSON): its ids ascend in merge order, which a
    rank encoder needs and the constructor checks, as it does that every byte has an id.  The
    second is a piece model; where none of its pieces has a blank inside, nothing merges across
    a blank between two other characters, so that each distinct chunk between single blanks is
    encoded once per block.  Other texts are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = {letter: b for b, letter in _byte_letters().items()}
        self.bytes_a = {}
        for token, number in model["vocab"].items():
            if all(c in byte for c in token):
                self.bytes_a[number] = bytes(byte[c] for c in token)
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or not {bytes([b]) for b in range(256)} <= set(self.bytes_a.values()):
            raise ValueError(f"{path_a} lacks bytes, or its ids do not follow its merges")
        self.a = tiktoken.Encoding(
            path_a, pat_str=PRETOKENS, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = {}
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
            else:
                # Neither control nor unknown pieces spell anything.
                odd = self.b.is_control(i) or self.b.is_unknown(i)
                self.bytes_b[i] = b"" if odd else piece.replace("▁", " ").encode()
        self.chunked = not any(b" " in t.lstrip(b" ") for t in self.bytes_b.values())
        self.length_a, self.length_b = self._lengths(self.bytes_a), self._lengths(self.bytes_b)
        self.pieces = pa.array([self.bytes_b[i] for i in range(len(self.bytes_b))], pa.large_binary())
        size = max(len(self.length_a), len(self.length_b))
        self.words = pa.array([str(i) + sign for sign in ",|;" for i in range(size)], pa.large_string())

    @staticmethod
    def _lengths(table: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(table) + 1, np.int64)
        out[list(table)] = [len(t) for t in table.values()]
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[pa.ListArray]]:
        """The places of the texts that tokens spell, and their ids by each vocabulary.

        Null and empty texts, and texts that the second vocabulary changes, are left out.
        """
        rows = [i for i, t in enumerate(texts) if t]
        cut = [texts[i].split(" ") if self.chunked else [texts[i]] for i in rows]
        # A chunk that is empty or begins or ends with white space is no chunk between two other characters.
        uneven = {c for c in set(chain.from_iterable(cut)) if not c or c[0].isspace() or c[-1].isspace()}
        if uneven:
            cut = [own if uneven.isdisjoint(own) else [texts[i]] for i, own in zip(rows, cut, strict=True)]
        number = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        chunks = number.dictionary.to_pylist()
        found = self.b.encode(chunks, num_threads=1) if chunks else []
        known = [_ragged(map(self.a.encode_ordinary, map(" ".__add__, chunks))), _ragged(found)]
        faithful = self._spell(known[1], chunks)
        of_chunk = number.indices.to_numpy()
        edges = np.cumsum([0, *map(len, cut)])
        if not faithful.all():
            wrong = set((np.searchsorted(edges, np.flatnonzero(~faithful[of_chunk]), "right") - 1).tolist())
            left = {rows[k] for k in wrong}
            return self.encode([None if i in left else t for i, t in enumerate(texts)])
        out = []
        for ids in known:
            taken = ids.take(number.indices)
            ends = np.concatenate([[0], np.cumsum(np.diff(taken.offsets.to_numpy()))])
            out.append(pa.LargeListArray.from_arrays(pa.array(ends[edges]), taken.flatten()))
        return rows, out

    def _spell(self, ids: pa.LargeListArray, chunks: list[str]) -> np.ndarray:
        """Whether the pieces of each chunk spell a blank and the chunk."""
        spelt = self.pieces.take(ids.values)
        want = [b" " + c.encode() for c in chunks]
        raw = spelt.buffers()[2].to_pybytes() if len(spelt) else b""
        ends = np.concatenate([[0], np.cumsum(self.length_b[ids.values.to_numpy()])])[ids.offsets.to_numpy()]
        lengths = np.fromiter(map(len, want), np.int64, len(want))
        if raw == b"".join(want) and (np.diff(ends) == lengths).all():
            return np.ones(len(want), bool)
        return np.array([raw[s:e] == w for s, e, w in zip(ends[:-1], ends[1:], want, strict=True)], bool)


def _ragged(lists: Iterable[list[int]]) -> pa.LargeListArray:
    lists = list(lists)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


# ---------------------------------------------------------------- texts


def _spelt(
    ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, words: pa.Array
) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """All groups as text ``a1,a2|b1;`` in one buffer, with the offset after every id and the
    places (among all ids in order) of the last ids of groups.

    ``words`` spells every id before a comma, then before a bar, then before a semicolon.
    """
    n_a, n_b, size = len(ids_a), len(ids_b), len(words) // 3
    # A group's first ids stand before its second ones.
    count_a = np.diff(np.concatenate([[-1], last_a]))
    count_b = np.diff(np.concatenate([[-1], last_b]))
    group_a, group_b = np.repeat(np.arange(len(last_a)), count_a), np.repeat(np.arange(len(last_b)), count_b)
    place_a = np.arange(n_a) + np.concatenate([[0], np.cumsum(count_b)])[group_a]
    place_b = np.arange(n_b) + np.cumsum(count_a)[group_b]
    which = np.empty(n_a + n_b, np.int64)
    which[place_a], which[place_b] = ids_a, ids_b
    which[place_a[last_a]] += size
    which[place_b[last_b]] += 2 * size
    taken = words.take(pa.array(which))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return taken.buffers()[2], offsets, place_b[last_b]


def _planes(values: np.ndarray) -> bytes:
    """Four-byte integers, all first bytes before all second ones, which compresses small values well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_COLUMNS = [
    ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.string()), ("links", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("holders", pa.binary()),
]


def _block(texts: list[str | None], known: Vocabularies) -> dict[str, list]:
    """The aligned texts of one block, and as a last row its distinct id pairs with their counts."""
    out: dict[str, list] = {name: [] for name, _ in _COLUMNS}
    rows, (ids_a, ids_b) = known.encode(texts)
    a, b = ids_a.values.to_numpy(), ids_b.values.to_numpy()
    n_a, n_b = np.diff(ids_a.offsets.to_numpy()), np.diff(ids_b.offsets.to_numpy())
    roots_a = np.cumsum(n_a) - 1
    ends_a, ends_b = np.cumsum(known.length_a[a]), np.cumsum(known.length_b[b])
    if len(ends_a) and ends_a[-1] < 1 << 31:
        ends_a, ends_b = ends_a.astype(np.int32), ends_b.astype(np.int32)
    last_a = shared_groups(ends_a, ends_b, roots_a)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    left, right = overlaps(ends_a, ends_b)
    text_of_link = np.searchsorted(roots_a, left)
    coded = pa.array(a[left] * PAIR + b[right]).dictionary_encode()
    pairs, slot = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    links, times = np.unique(text_of_link * max(1, len(pairs)) + slot, return_counts=True)
    holders = np.bincount(links % max(1, len(pairs)), minlength=len(pairs))
    owner = links // max(1, len(pairs))
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    n_links = np.bincount(text_of_link, minlength=len(rows))
    group_edges = np.concatenate([[0], np.searchsorted(last_a, roots_a) + 1])
    if len(rows):
        data, offsets, closing = _spelt(a, b, last_a, last_b, known.words)
        raw = memoryview(data)
    at = {row: n for n, row in enumerate(rows)}
    for row in range(len(texts)):
        n = at.get(row)
        if n is None:
            values = (0, 0, 0, 0, "", b"", b"")
        else:
            first = 0 if n == 0 else closing[group_edges[n] - 1] + 1
            # The sign after a text's last id is left out.
            spelt = bytes(raw[offsets[first] : offsets[closing[group_edges[n + 1] - 1] + 1] - 1]).decode()
            own = slice(edges[n], edges[n + 1])
            values = (
                int(n_a[n]), int(n_b[n]), int(group_edges[n + 1] - group_edges[n]), int(n_links[n]), spelt,
                _planes(links[own] % len(pairs)), _planes(times[own]),
            )
        for name, value in zip(("n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"), values, strict=True):
            out[name].append(value)
        out["pairs"].append(None)
        out["holders"].append(None)
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"):
        out[name].append(None)
    out["pairs"].append(pairs.astype("<i8").tobytes())
    out["holders"].append(holders.astype("<i8").tobytes())
    out["block"] = [uuid.uuid4().int >> 65] * (len(texts) + 1)
    return out


def align_payloads(
    records: DataFrame, path_a: str, path_b: str, key: str = "source_event_id", text: str = "payload",
    digest: bool = False, block_bytes: int = 2 << 20,
) -> DataFrame:
    """How the tokens of two vocabularies meet in every record's text, one row a record.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  A blank and the text are encoded
    by ``path_a`` (byte-level merges, JSON), the text by ``path_b`` (a piece model, which puts
    the blank itself).  Byte offsets at which tokens of both end cut them into groups
    (:func:`shared_groups`); tokens whose bytes overlap are linked, and a pair of ids counts as
    often as records of all of ``records`` hold it linked.

    Returns ``key, n_a, n_b, n_groups, n_links, n_best`` (links whose count is the highest of
    their first id, ties included), ``count_sum`` (over links) and ``groups``: decimal ids as
    ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that text, which needs no room in
    the written table.  Null and empty texts and those whose tokens do not spell them have
    zeros and ``''``.  Null and repeated keys stay rows of their own, further columns are
    ignored, and every text is read whole.

    Texts lie in blocks of about ``block_bytes``.  Pairs are counted per block before they are
    shuffled, and return to their block as one row per distinct pair of it, so that a pair
    that all records hold costs a row a block.  The only broadcast table has a row per id of
    the first vocabulary.
    """
    kind = records.schema[key].dataType
    names = [name for name, _ in _COLUMNS]
    simple = {"int64": "bigint", "string": "string", "binary": "binary"}
    schema = ", ".join(f"{name} {simple[str(t)]}" for name, t in _COLUMNS)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(path_a, path_b)
        for batch in small_batches(batches, "text", block_bytes):
            out = _block(batch["text"].to_pylist(), known)
            keys = pa.concat_arrays([batch["key"], pa.nulls(1, batch["key"].type)])
            yield pa.record_batch(
                [keys, *(pa.array(out[name], t) for name, t in _COLUMNS)], names=["key", *names]
            )

    aligned = records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        align, f"key {kind.simpleString()}, {schema}"
    )
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.col("groups")))
    aligned = durable(aligned)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, holders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                yield pa.record_batch(
                    [pa.array(np.full(len(pair), block)), pa.array(np.arange(len(pair))), pa.array(pair), pa.array(np.frombuffer(holders, "<i8"))],
                    names=["block", "slot", "pair", "n"],
                )

    held = aligned.where("pairs is not null").select("block", "pairs", "holders").mapInArrow(
        unpack, "block bigint, slot bigint, pair bigint, n bigint"
    )
    counts = durable(held.groupBy("pair").agg(F.sum("n").alias("count")))
    first = F.shiftright("pair", 24)
    # At most one row per id of the first vocabulary.
    highest = counts.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))
    rated = counts.withColumn("first", first).join(F.broadcast(highest), "first").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    returned = held.select("block", "slot", "pair").join(rated, "pair").select("block", "slot", "count", "best")
    texts = aligned.where("pairs is null").drop("pairs", "holders")
    sums = [("n_best", pa.int64()), ("count_sum", pa.int64())]
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def rate(own: pa.Table, found: pa.Table) -> pa.Table:
        count = np.zeros(found.num_rows, np.int64)
        best = np.zeros(found.num_rows, np.int64)
        slot = found["slot"].to_numpy()
        count[slot], best[slot] = found["count"].to_numpy(), found["best"].to_numpy()
        n_best, total = [], []
        for links, times in zip(own["links"].to_pylist(), own["times"].to_pylist(), strict=True):
            at, n = _from_planes(links), _from_planes(times)
            n_best.append(int((best[at] * n).sum()))
            total.append(int((count[at] * n).sum()))
        out = own.select(kept)
        for (name, t), values in zip(sums, (n_best, total), strict=True):
            out = out.append_column(name, pa.array(values, t))
        return out

    result = texts.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(
        rate,
        f"key {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint",
    )
    return result.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"
    )
