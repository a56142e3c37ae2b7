"""Leaks: planted items with edits are found, other texts stay."""

import random

import numpy as np
import pytest

from shotspark.llm.leaks import Items, Walks, drop_leaks, find_leaks, least_edits


def edit_distance_in(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(region, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def words(draw, n):
    part = "th er on an in ea re nd ou st ti es ble wh".split()
    return " ".join("".join(draw.choices(part, k=draw.randrange(1, 4))) for _ in range(n))


def test_bit_vectors_agree_with_the_table():
    draw = random.Random(1)
    for _ in range(60):
        item, region = words(draw, 8), words(draw, 20)
        if draw.random() < 0.5:
            region = region[:30] + item[2:-3] + region[30:]
        masks = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in set(item)}
        assert least_edits(item, region, masks) == edit_distance_in(item, region)


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(2)
    items = [(i, words(draw, draw.randrange(12, 40))) for i in range(40)]
    texts = []
    for i, item in items:
        changed = list(item)
        for _ in range(len(item) * (i % 3) // 20):
            changed[draw.randrange(len(changed))] = draw.choice("abcdehinorst")
        texts.append((f"leak{i}", f"{words(draw, 60)}, {''.join(changed).upper()}\n{words(draw, 50)}"))
    return items, texts + [(f"clean{i}", words(draw, 150)) for i in range(60)]


def test_recall_and_precision(spark, planted):
    items, texts = planted
    records = spark.createDataFrame([(*t, "c") for t in texts], "source_event_id string, payload string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (20_000, 15):
        got = {(r.source_event_id, r.item_id) for r in find_leaks(records, bench, block_items=block).collect()}
        want = {(f"leak{i}", i) for i, _ in items}
        assert got <= want and len(got) >= 0.95 * len(want)
        kept = drop_leaks(records, bench, block_items=block)
        assert kept.columns == records.columns
        assert {r.source_event_id for r in kept.collect()} == {t for t, _ in texts} - {t for t, _ in got}


def test_odd_rows(spark):
    records = spark.createDataFrame(
        [("a", None), ("a", ""), (None, "one two three four five"), ("b", "x " * 300_000), ("c", "ONE,two three; four five")] * 2,
        "source_event_id string, payload string",
    )
    bench = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "one"), (3, None)], "item_id int, text string")
    got = sorted((tuple(r) for r in find_leaks(records, bench).collect()), key=str)
    assert got == sorted([(None, 1, 0, 23, 1.0), ("c", 1, 0, 23, 1.0)] * 2, key=str)
    assert drop_leaks(records, bench).count() == 6
    assert find_leaks(records, bench.limit(0)).count() == 0
    assert drop_leaks(records, bench.limit(0)).count() == 10
    assert find_leaks(records.limit(0), bench).count() == 0


def test_equal_strings_have_equal_keys():
    index = Items([("i", "some words of a little text")], 0.75, 8, 5, Walks(2, 4, 3))
    assert index.search(["x. Some words, of a little text"]) == [(0, 0, 0)]


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25])
def test_recall_up_to_the_accepted_edits(share):
    draw = random.Random(7)
    items = [(i, words(draw, draw.randrange(16, 60))) for i in range(150)]
    index = Items(items, 0.75, 6, 5, Walks(3, 32, 2))
    texts = []
    for _, item in items:
        changed = list(item)
        for i in draw.sample(range(len(item)), int(share * len(item))):
            changed[i] = draw.choice("abcdehinorst")
        texts.append(f"{words(draw, 60)} {''.join(changed)} {words(draw, 50)}")
    want = {(i, i) for i, item in items if edit_distance_in(item, texts[i]) <= len(item) // 4}
    got = {(number, item) for number, item, _ in index.search(texts)}
    assert len(want) >= 145 and len(got & want) >= 0.95 * len(want)


def test_copy_whose_longest_words_are_all_edited():
    words = "which of the seven old towns lies at the mouth of a river that freezes over in winter".split()
    index = Items([("i", " ".join(words))], 0.75, 6, 5, Walks(3, 32, 2))
    longest = sorted(range(len(words)), key=lambda i: -len(words[i]))[:8]
    edited = [w[:-1] + "x" if i in longest else w for i, w in enumerate(words)]
    assert [(n, i) for n, i, _ in index.search(["so: " + " ".join(edited) + ", then"])] == [(0, 0)]


def test_short_items_and_items_without_spaces():
    items = [(0, "What causes ocean tides?"), (1, "Ocean tides rise"), (2, "什么力量会导致海洋的潮汐"), (3, "潮汐是什么引起"), (4, "tides"),
             (5, "月亮绕着地球转动的时候海水为什么会上涨又为什么会退落")]
    index = Items(items, 0.75, 6, 12, Walks(3, 32, 2))
    texts = [
        "Asked: what causes ocean tides? The moon.", "the ocean tides rise now", "the ocean tide rise now", "ocean tides risen by",
        "ocean xides risk", "他问什么力量会导致海洋的潮汐答月亮", "他问什么力量能导致海洋的潮汐答", "你知道潮汐是什么引起的吗", "tides",
        "问月亮绕着地球转动时候海水为何会上涨又为什么会退落啊",
    ]
    got = {(number, item) for number, item, _ in index.search(texts)}
    # "ocean tides risen" is one edit from the item, "ocean xides risk" two; "tides" is no item.
    assert got == {(0, 0), (1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (7, 3), (9, 4)}


def test_windows_are_laid_at_every_start():
    """The right start is only the fifth likeliest, and keys agree nowhere else."""

    class First(Walks):
        def keys(self, windows, sizes):
            return windows[:, :12].astype("uint64") @ (31 ** np.arange(12, dtype="uint64"))[:, None]

    draw = random.Random(5)
    item = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=130))
    text = "0".join([item[:12], item[12:41], item[41:70], item[70:100], item[100:]])
    index = Items([(7, item)], 0.75, 6, 12, First(1, 1, 1))
    assert index.search([text, "x" * 200]) == [(0, 0, 4)]
