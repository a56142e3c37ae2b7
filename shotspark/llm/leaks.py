"""Benchmark items that occur, whole and possibly edited, in texts.

Places come from the whole text: wherever enough q-grams of an item lie so that they put the
item's start at nearly the same character, windows as long as the item are laid at all these
starts, those that most q-grams agree on first.  No place within about a seventh of the item's length in edits is
missed by that; beyond, up to the accepted quarter, one is missed only if its edits leave
hardly any q-gram whole.  Window and item are embedded
by random walks in the way of Chakraborty, Goldenberg and Koucky: step ``t`` emits the
character under the cursor and moves on or stays, as a random bit of ``t`` and that character
says.  Close strings fall into step again after an edit, so a small edit distance becomes a
small Hamming distance.  Repeated samples of a few emitted characters are the keys of a
locality-sensitive hash; a window that shares a key with its item is verified by exact
approximate matching, with bit vectors.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shotspark.llm.texts import small_batches
from shotspark.session import durable

WORD = re.compile(r"\w+")
#: A stretch is looked at from one shared q-gram for so many characters of the item on.
SHARE = 12
#: Starts of a stretch that are tried before its others.
FIRST = 4
#: Items below so many characters have q-grams of four.
SHORT = 48
HASH_BITS = 20
#: Characters from here on count as two, and scripts that write them do not part words.
WIDE = "\u2e80"
#: Items of fewer than five words and of less than this size are matched whole.
WHOLE = 24
FOUND = "edits bigint, item_chars bigint, similarity double"


class Walks:
    """Random walks and the sampled steps of each; the same for every window and item."""

    def __init__(self, walks: int, keys: int, sampled: int, seed: int = 31):
        draw = np.random.default_rng(seed)
        self.seeds = draw.integers(1, 1 << 62, walks, dtype=np.uint64)
        self.places = draw.random((walks, keys, sampled))
        self.weights = draw.integers(1, 1 << 62, sampled, dtype=np.uint64) | np.uint64(1)
        self.moves: list[np.ndarray] = [np.empty((0, 256), np.uint8) for _ in range(walks)]

    def _moves(self, walk: int, steps: int) -> np.ndarray:
        if len(self.moves[walk]) < steps:
            draw = np.random.default_rng(int(self.seeds[walk]))
            self.moves[walk] = draw.integers(0, 2, (2 * steps, 256), dtype=np.uint8)
            self.moves[walk][:, 0] = 0  # the cursor rests on the first cell after the window
        return self.moves[walk]

    def keys(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of every row of ``windows`` (codes, then at least one 0): rows x (walks * keys)."""
        count, width = windows.shape
        steps = 2 * int(sizes.max())
        flat, first, rows = windows.ravel(), np.arange(count) * width, np.arange(count)
        out = []
        for walk, places in enumerate(self.places):
            moves = self._moves(walk, steps)
            at = first.copy()
            emitted = np.empty((steps, count), np.uint8)
            for t in range(steps):
                code = flat.take(at, out=emitted[t], mode="clip")
                at += moves[t].take(code)
            for place in places:
                key = np.zeros(count, np.uint64)
                for share, weight in zip(place, self.weights, strict=True):
                    step = (share * 2 * sizes).astype(np.int64)
                    key = key * np.uint64(257) + emitted[step, rows] * weight
                out.append(key)
        return np.stack(out, axis=1)


def least_edits(item: str, region: str, masks: dict[str, int]) -> int:
    """Smallest edit distance between ``item`` and any substring of ``region``.

    One column of the edit table is kept as two bit vectors (rises and falls); ``masks`` has
    the places of every character in the item.
    """
    n = len(item)
    top = 1 << (n - 1)
    full = (1 << n) - 1
    up, down, score = full, 0, n
    best = n
    for ch in region:
        eq = masks.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score < best:
            best = score
        # A match may begin anywhere: the row above the item stays zero.
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
    return best


def codes(text: str) -> np.ndarray:
    """Characters as 1 .. 255."""
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % 255 + 1).astype(np.uint8)


def edits_to_one(a: str, b: str) -> int:
    """Edit distance of two strings, 2 for more than one."""
    if a == b:
        return 0
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    rest = (a[head + 1 :], b[head + 1 :]) if len(a) == len(b) else (a[head + (len(a) > len(b)) :], b[head + (len(b) > len(a)) :])
    return 1 if rest[0] == rest[1] else 2


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hash below ``1 << HASH_BITS`` of every ``size`` neighbouring characters."""
    count = max(0, len(text) - size + 1)
    mixed = np.zeros(count, np.uint32)
    for i in range(size):
        mixed *= np.uint32(0x01000193)
        mixed += text[i : i + count]
    mixed *= np.uint32(0x9E3779B1)
    return mixed >> np.uint32(32 - HASH_BITS)


def likeliest(starts: np.ndarray) -> list[int]:
    """All different starts, those that most q-grams agree on first."""
    each, count = np.unique(np.maximum(starts, 0), return_counts=True)
    return each[np.argsort(-count, kind="stable")].tolist()


class Items:
    """A block of items, normalised to words and single spaces, with their q-grams and keys."""

    def __init__(self, items: list[tuple], similarity: float, gram: int, least_chars: int, walks: Walks):
        self.walks, self.ids, self.texts, self.edits = walks, [], [], []
        whole = []
        for item, text in items:
            words = WORD.findall((text or "").lower())
            plain = " ".join(words)
            size = len(plain) + sum(ch >= WIDE for ch in plain)
            if size < least_chars and len(words) < 5:
                continue
            # A short item is one only where its words stand whole, with an edit at most.
            whole.append(len(words) < 5 and size < WHOLE)
            self.ids.append(item)
            self.texts.append(plain)
            self.edits.append(min(math.floor((1 - similarity) * len(plain) + 1e-9), 1 if whole[-1] else len(plain)))
        self.whole = np.array(whole, bool)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array(self.edits, np.int64)
        self.shared = np.maximum(1, self.sizes // SHARE)
        self.masks = []
        for text in self.texts:
            masks: dict[str, int] = defaultdict(int)
            for i, ch in enumerate(text):
                masks[ch] |= 1 << i
            self.masks.append(dict(masks))
        if self.ids:
            self.keys = walks.keys(self._rows([codes(t) for t in self.texts]), self.sizes)
            # Short items are told apart by shorter q-grams, as few of theirs stay whole.
            size_of = np.minimum(np.where(self.sizes < SHORT, 4, gram), np.maximum(1, self.sizes // 2))
            size_of = np.minimum(size_of, gram)
            self.grams = [self._grams(np.flatnonzero(size_of == size), int(size)) for size in np.unique(size_of)]

    def _grams(self, numbers: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(size, first, items, offsets): entries ``first[h]`` to ``first[h + 1]`` are the q-grams of hash ``h``."""
        hashes = [gram_hashes(points(self.texts[i]), size) for i in numbers]
        items = np.repeat(numbers, [len(h) for h in hashes])
        offsets = np.concatenate([np.arange(len(h)) for h in hashes])
        hashed = np.concatenate(hashes)
        order = np.argsort(hashed, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(hashed, minlength=1 << HASH_BITS))])
        return size, first.astype(np.int32), items[order], offsets[order]

    def _rows(self, windows: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(windows), max(map(len, windows)) + 1), np.uint8)
        for row, window in zip(rows, windows, strict=True):
            row[: len(window)] = window
        return rows

    def _places(self, text: np.ndarray, hits: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(item, ascending starts) of every stretch of a text that holds enough q-grams of the item.

        A q-gram at ``p`` of the text and ``o`` of the item lays the item's start at ``p - o``.
        An occurrence with ``k`` edits keeps all but ``q * k`` q-grams, and their starts differ
        by ``k`` at most: so many starts that close together are looked for.
        """
        for size, first, items, offsets in self.grams:
            if len(text) < size:
                continue
            hashed = gram_hashes(text, size)
            low = first[hashed]
            count = first[hashed + 1] - low
            at = np.flatnonzero(count)
            low, count = low[at], count[at]
            ends = np.cumsum(count, dtype=np.int64)
            reach = int(self.sizes.max())
            begin = 0
            while begin < len(at):
                # About ``hits`` q-grams at once; the next part reads the last ones again.
                done = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + hits, "right")))
                if end < len(at):
                    end = max(end, int(np.searchsorted(at, at[begin] + 4 * reach, "right")))
                n = count[begin:end]
                entry = np.arange(int(n.sum())) + np.repeat(low[begin:end] - (np.cumsum(n) - n), n)
                start = np.repeat(at[begin:end], n) - offsets[entry] + reach
                found = np.sort(items[entry] << 40 | start)
                item, start = found >> 40, (found & ((1 << 40) - 1)) - reach
                other = np.arange(len(found)) + self.shared[item] - 1
                known = np.minimum(other, len(found) - 1)
                close = (other < len(found)) & (found[known] - found <= self.most[item])
                first_of = np.flatnonzero(close)
                last_of = known[first_of]
                if len(first_of):
                    # Stretches that overlap are one.
                    cut = np.flatnonzero((first_of[1:] > last_of[:-1]) | (item[first_of[1:]] != item[first_of[:-1]])) + 1
                    for i, j in zip(first_of[np.r_[0, cut]], last_of[np.r_[cut - 1, -1]], strict=True):
                        yield int(item[i]), start[i : j + 1]
                if end == len(at):
                    break
                begin = max(begin + 1, int(np.searchsorted(at, at[end - 1] - 2 * reach)))

    def _whole(self, item: int, text: str, starts: np.ndarray) -> int:
        """Fewest edits from a short item to a run of whole words near ``starts``; between wide characters words end anywhere."""
        own, most = self.texts[item], self.edits[item]
        best = most + 1
        border = lambda i: i in (0, len(text)) or " " in text[i - 1 : i + 1] or max(text[i - 1 : i + 1]) >= WIDE
        for begin in sorted({int(x) + d for x in np.unique(starts) for d in range(-most, most + 1)}):
            if not 0 <= begin < len(text) or not border(begin):
                continue
            for end in range(begin + len(own) - most, begin + len(own) + most + 1):
                if end <= len(text) and border(end):
                    best = min(best, edits_to_one(own, text[begin:end]))
        return best

    def search(self, texts: list[str], block: int = 4096) -> list[tuple[int, int, int]]:
        """(text number, item number, edits) of every leak found."""
        stretches: list[tuple[int, int, np.ndarray]] = []
        plain: dict[int, str] = {}
        for number, text in enumerate(texts):
            words = " ".join(WORD.findall(text.lower()))
            for item, starts in self._places(points(words)):
                plain[number] = words
                stretches.append((number, item, starts))
        found: dict[tuple[int, int], int] = {}
        coded = {number: codes(text) for number, text in plain.items()}
        # Windows of like size walk together.
        stretches.sort(key=lambda s: self.sizes[s[1]])
        laid = [likeliest(starts) for _, _, starts in stretches]
        short = np.array([self.whole[item] for _, item, _ in stretches], bool)
        alike = np.zeros(len(stretches), bool)

        def walk(asked: list[tuple[int, int]]) -> None:
            for at in range(0, len(asked), block):
                part = asked[at : at + block]
                own = np.array([s for s, _ in part])
                items = np.array([stretches[s][1] for s in own])
                windows = [coded[stretches[s][0]][start : start + int(self.sizes[stretches[s][1]])] for s, start in part]
                keys = self.walks.keys(self._rows(windows), self.sizes[items])
                alike[own[(keys == self.keys[items]).any(axis=1)]] = True

        # The likeliest starts decide most stretches; what they leave open is asked at every other start.
        walk([(s, start) for s, starts in enumerate(laid) if not short[s] for start in starts[:FIRST]])
        walk([(s, start) for s, starts in enumerate(laid) if not (short[s] or alike[s]) for start in starts[FIRST:]])
        for s in np.flatnonzero(alike | short):
            number, item, starts = stretches[s]
            most = self.edits[item]
            if self.whole[item]:
                edits = self._whole(item, plain[number], starts)
                if edits <= most:
                    found[number, item] = min(edits, found.get((number, item), edits))
                continue
            if found.get((number, item), most + 1) == 0:
                continue
            region = plain[number][max(0, int(starts[0]) - most) : max(0, int(starts[-1])) + int(self.sizes[item]) + most]
            edits = least_edits(self.texts[item], region, self.masks[item])
            if edits <= most:
                found[number, item] = min(edits, found.get((number, item), edits))
        return [(number, item, edits) for (number, item), edits in found.items()]


def _item_blocks(items: DataFrame, item_key: str, item_text: str, block_items: int) -> tuple[DataFrame, int]:
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("item_words")).distinct()
    return items, max(1, math.ceil(items.count() / block_items))


def _index(items: DataFrame, blocks: int, block: int, *settings) -> Items:
    """The items of one block, of a size that does not depend on the corpus."""
    own = items.filter(F.pmod(F.xxhash64("item", "item_words"), F.lit(blocks)) == block).orderBy("item", "item_words")
    return Items([tuple(r) for r in own.collect()], *settings)


def find_leaks(
    records: DataFrame, items: DataFrame, key: str = "source_event_id", text: str = "payload",
    item_key: str = "item_id", item_text: str = "text", similarity: float = 0.75, gram: int = 6,
    walks: int = 3, keys: int = 32, sampled: int = 2, least_chars: int = 12, block_items: int = 20_000,
) -> DataFrame:
    """Pairs of a record and a benchmark item that its text contains, edits allowed.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); it has no benchmarks, so the item table is general (``item_id``, ``text``).
    Texts and items are compared as lower-case words joined by one space.  A pair is found
    when some substring of the record's text is within ``(1 - similarity)`` of the item's
    length in edits, one for every ``SHARE`` characters of the item's q-grams of ``gram``
    characters stands there, and the keys of a window agree once.

    Result, a row per pair: the key, the item's key, ``edits`` (the smallest seen at the windows
    that led there), ``item_chars`` and ``similarity`` (1 - edits / chars).  Items of fewer than five words and
    less than ``least_chars`` characters (wide ones, as of Chinese and Japanese, count twice) say too little
    and are found nowhere; larger ones of fewer than five words and less than ``WHOLE`` are found
    as whole words with at most one edit; null texts are empty; repeated
    rows give repeated pairs, repeated items count once; further columns are ignored.  Items
    travel with the tasks in blocks of ``block_items``, one pass over the texts for each.
    """
    items, blocks = _item_blocks(items, item_key, item_text, block_items)
    record_kind, item_kind = records.schema[key].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item"].dataType)
    schema = f"record {record_kind}, item {item_kind}, {FOUND}"
    names = [x.split()[0] for x in schema.split(", ")]
    plain = records.select(F.col(key).alias("record"), F.col(text).cast("string").alias("text"))

    def passing(block: int) -> DataFrame:
        index = _index(items, blocks, block, similarity, gram, least_chars, Walks(walks, keys, sampled))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                if not index.ids:
                    continue
                found = index.search([t or "" for t in batch.column(1).to_pylist()])
                which = pa.array([n for n, _, _ in found], pa.int64())
                size = [len(index.texts[i]) for _, i, _ in found]
                edits = [e for _, _, e in found]
                yield pa.record_batch(
                    [
                        batch.column(0).take(which),
                        pa.array([index.ids[i] for _, i, _ in found], item_type),
                        pa.array(edits, pa.int64()), pa.array(size, pa.int64()),
                        pa.array([1 - e / s for e, s in zip(edits, size, strict=True)], pa.float64()),
                    ],
                    names=names,
                )

        return plain.mapInArrow(scan, schema)

    found = passing(0)
    for block in range(1, blocks):
        found = durable(found.unionByName(passing(block)))
    return found.withColumnsRenamed({"record": key, "item": item_key})


def drop_leaks(
    records: DataFrame, items: DataFrame, text: str = "payload", item_key: str = "item_id", item_text: str = "text",
    similarity: float = 0.75, gram: int = 6, walks: int = 3, keys: int = 32, sampled: int = 2,
    least_chars: int = 12, block_items: int = 20_000,
) -> DataFrame:
    """The records, with all their columns, in which :func:`find_leaks` finds no item."""
    items, blocks = _item_blocks(items, item_key, item_text, block_items)
    for block in range(blocks):
        index = _index(items, blocks, block, similarity, gram, least_chars, Walks(walks, keys, sampled))

        def clean(batches: Iterator[pa.RecordBatch], index: Items = index) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, text):
                keep = np.ones(batch.num_rows, bool)
                if index.ids:
                    found = index.search([t or "" for t in batch.column(text).to_pylist()])
                    keep[[number for number, _, _ in found]] = False
                yield batch.filter(pa.array(keep))

        records = records.mapInArrow(clean, records.schema)
    return records
