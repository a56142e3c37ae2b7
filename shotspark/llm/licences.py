"""License notices in text blocks: an exact set-similarity join with templates.

A template is the set of its words.  A block, a run of words or a line, meets it when it
holds at least ``containment`` of that set.  Words are ordered by their frequency over all
texts, rarest first.  A block that meets a template of ``n`` words, of which ``need`` must be
there, holds one of the template's ``n - need + 1`` rarest words (prefix filter), has ``need``
words at least (length filter), and from its first shared word on leaves room for ``need``
(positional filter); what passes is counted in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches

# Phrases that name a license wherever their words stand together.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices by which texts place themselves under a license.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright under CC0 1.0"),
)

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII digits and letters and of everything beyond ASCII."""
    return WORD.findall(text.translate(UPPER))


class TemplateIndex:
    """Templates as word sets in frequency order, with the prefix words of each."""

    def __init__(self, templates, frequency: dict[bytes, int], containment: float):
        known = sorted({w for _, t in templates for w in words_of(t.encode())}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.sets, self.need, self.labels = [], [], []
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            own = sorted({self.rank[w] for w in words_of(text.encode())})
            if not own:
                continue
            need = max(1, math.ceil(containment * len(own) - 1e-9))
            for at, token in enumerate(own[: len(own) - need + 1]):
                self.prefixes[token].append((len(self.sets), at))
            self.sets.append(frozenset(own))
            self.need.append(need)
            self.labels.append(label)
        self.span = 2 * max((len(words_of(t.encode())) for _, t in templates), default=1)

    def matches(self, block: list[int]) -> dict[int, float]:
        """Template number to containment, for the known words of one block."""
        own = sorted(set(block))
        checked: dict[int, float] = {}
        for at, token in enumerate(own):
            for template, position in self.prefixes.get(token, ()):
                if template in checked:
                    continue
                size, need = len(self.sets[template]), self.need[template]
                if len(own) - at < need or size - position < need:
                    continue
                share = len(self.sets[template].intersection(own[at:]))
                checked[template] = share / size if share >= need else 0.0
        return {t: share for t, share in checked.items() if share}

    def told_apart(self, block: list[int]) -> dict[int, float]:
        """The templates a block meets, without those whose words are all among what better ones matched.

        Better is what matched more words; of equal matches, the fullest template, then the largest.
        """
        met = self.matches(block)
        if len(met) < 2:
            return met
        words = {t: self.sets[t].intersection(block) for t in met}
        better = {t: (len(words[t]), met[t], len(self.sets[t]), -t) for t in met}
        return {
            t: share for t, share in met.items()
            if not words[t] <= frozenset().union(*(words[u] for u in met if better[t] < better[u]))
        }

    def best(self, text: bytes) -> dict[str, float]:
        """Label to best containment over all blocks of a text.

        Blocks are lines, or where a line is longer than ``span`` words, windows of that many
        words that overlap by half; and such windows over the words of the whole text, so that
        every template-sized run lies in one of them however it is wrapped.
        """
        found: dict[str, float] = {}
        rank = self.rank
        half = self.span // 2
        blocks: dict[tuple[int, int], list[int]] = defaultdict(list)
        before = 0
        for number, line in enumerate(text.translate(UPPER).split(b"\n"), 1):
            words = WORD.findall(line)
            for i, word in enumerate(words):
                token = rank.get(word)
                if token is None:
                    continue
                for of, place in ((number, i), (0, before + i)):
                    at = place // half
                    blocks[of, at].append(token)
                    if at:
                        blocks[of, at - 1].append(token)
            before += len(words)
        for block in {tuple(sorted(set(block))) for block in blocks.values()}:
            for template, share in self.told_apart(block).items():
                label = self.labels[template]
                found[label] = max(found.get(label, 0.0), share)
        return found


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(word number, label) of every place where a phrase's words stand consecutively."""
    places = []
    last = phrases and {p[-1] for p, _ in phrases}
    for i, word in enumerate(words):
        if word in last:
            for phrase, label in phrases:
                start = i - len(phrase) + 1
                if start >= 0 and words[start : i + 1] == phrase:
                    places.append((start, label))
    return places


def word_frequency(records: DataFrame, text: str, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many texts each template word occurs, over all records; as many rows as template words."""
    known = {w for _, t in templates for w in words_of(t.encode())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches, text):
            for t in batch.column(0).cast(pa.binary()):
                seen.update(known.intersection(words_of(t.as_py() or b"")))
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = records.select(F.col(text).cast("string").alias(text)).mapInArrow(count, "word binary, n bigint")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licences(
    records: DataFrame, key: str = "source_event_id", text: str = "payload",
    containment: float = 0.8, templates=TEMPLATES, phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """License phrases and notices of every text, read whole.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  Result: the key, ``n_words``,
    ``n_base`` (all places of ``phrases``), ``first_word`` and ``last_word`` (smallest and
    largest start of a place, words from 0, null without one), ``base_labels``, ``labels``
    (with those of templates contained to at least ``containment`` in one block; both
    distinct, sorted, comma-joined) and ``score`` (1 for a phrase, else the best containment,
    else 0).  A null text is empty; repeated rows give repeated rows; further columns are
    ignored.  Templates and phrases are parameters of fixed size and travel with the task.
    """
    index = TemplateIndex(templates, word_frequency(records, text, templates), containment)
    spelt = [(words_of(p.encode()), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                raw = t.as_py() or b""
                words = words_of(raw)
                places = phrase_places(words, spelt)
                base = {label for _, label in places}
                near = index.best(raw)
                starts = [i for i, _ in places]
                score = 1.0 if base else max(near.values(), default=0.0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | near.keys())), score))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[key, *(x.split()[0] for x in FOUND.split(", "))],
            )

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(scan, f"{key} {kind}, {FOUND}")
