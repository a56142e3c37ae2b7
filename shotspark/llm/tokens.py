"""Token ids of whole texts, with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import array
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.packing import cut_points
from shotspark.llm.texts import small_batches

PIECES = (
    "key bigint, video_id string, scene_no bigint, start_frame bigint, end_frame bigint, "
    "ids_crc32 bigint, doc_tokens bigint"
)

#: A run of letters, then signs other than apostrophes: two pre-tokens that never merge.
PLAIN = regex.compile(r"(\p{L}+)([^\s\p{L}\p{N}']*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (rule of that format)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Ids(dict):
    """Little-endian uint32 ids of a chunk between ASCII white space, with a bounded cache.

    The first ``limit`` chunks and words stay, which the frequent ones are among.

    The vocabulary drops white space and never merges across it, so the ids of a text are
    those of its chunks in order.  Plain words go to the merge model directly, everything
    else through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.limit = limit

    def _part(self, word: str) -> bytes:
        ids = self.parts.get(word)
        if ids is None:
            spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = array.array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(self.parts) < self.limit:
                self.parts[word] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        # The vocabulary lower-cases letter by letter, str.lower() ends words with another sigma.
        plain = PLAIN.fullmatch(text) if len(text) < 100 and "\u03a3" not in text else None
        if plain and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            ids = self._part(plain[1].lower())
            if plain[2]:
                ids += self._part(plain[2])
        else:
            ids = array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(chunk) < 100 and len(self) < self.limit:
            self[chunk] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def scenes_of_texts(
    texts: DataFrame, path: str, end_id: int, window: int = 2048, grain: int = 512
) -> DataFrame:
    """Every text (``key BIGINT, text STRING``) as a row of scenes whose frames are its tokens.

    A text's ids are those of its chunks and then ``end_id``; null is empty.  ``video_id`` is
    the key as text and ``scene_no`` counts the pieces, cut where :func:`pack_scenes` cuts.
    ``ids_crc32`` is the checksum of a piece's ids, ``doc_tokens`` the text's token count.
    Repeated rows give repeated scenes; further columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        last = array.array("I", [end_id]).tobytes()
        for batch in small_batches(batches, "text"):
            rows: list[tuple] = []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                own = ids.of(text.as_py() or b"") + last
                count = len(own) // 4
                name = None if key is None else str(key)
                for number, (start, length) in enumerate(cut_points(count, window, grain)):
                    crc = zlib.crc32(own[4 * start : 4 * (start + length)])
                    rows.append((key, name, number, start, start + length - 1, crc, count))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return texts.select(F.col("key").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)
