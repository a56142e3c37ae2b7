"""Repeated passages against a count of all substrings."""

import hashlib
import random
from collections import Counter

import numpy as np

from shotspark.llm.passages import merge_spans, remove_repeated_passages, triggers


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~cover].tobytes()
        yield len(r), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()


def check(spark, texts, length, gram):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "source_event_id int, payload string, digest string")
    got = {r[0]: tuple(r)[1:] for r in remove_repeated_passages(df, length=length, gram=gram).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_shared_passages_copies_and_periods(spark):
    draw = random.Random(6)
    noise = lambda n: "".join(draw.choices("abcdefé ", k=n))
    shared, other = noise(90), noise(60)
    texts = [noise(50) + shared + noise(50) for _ in range(8)] + [noise(20) + shared[:70] + other, other + noise(9) + shared[20:]]
    texts += [shared] * 3 + ["ab" * 150, "x" * 200, noise(30) + "ab" * 40, "", None, noise(5), noise(40), other[:41]]
    texts += [shared[:45] + noise(3) + shared[45:], noise(300) * 2, noise(70) + shared[10:51] + noise(70)]
    check(spark, texts, 40, 8)


def test_nothing_long_enough(spark):
    check(spark, ["short", None, ""], 40, 8)
    df = spark.createDataFrame([], "source_event_id int, payload string")
    assert remove_repeated_passages(df).count() == 0


def test_every_window_has_one_trigger():
    grams = np.random.default_rng(1).integers(1, 1 << 63, 500, dtype=np.uint64)
    place, first, last = triggers(grams, 37)
    assert first[0] == 0 and last[-1] == 500 - 37 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place <= first + 36).all()


def test_merge_spans():
    assert merge_spans(np.array([5, 0, 2, 9]), np.array([7, 3, 4, 10])) == [(0, 4), (5, 7), (9, 10)]
    assert merge_spans(np.array([0, 4]), np.array([4, 6])) == [(0, 6)]
