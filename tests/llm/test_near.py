"""Near-duplicates against all pairs; components against union-find."""

import random

import numpy as np

from shotspark.llm.components import connected_components
from shotspark.llm.near import BITS, describe, estimate, find_near_duplicates
from shotspark.llm.shingles import shingle_set, word_hashes


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
    words = [w for w in words.translate(str.maketrans("\t\n\x0c\r", "    ")).split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def near_copies(seed, n):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(60)]
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(0, 4)):
            own[draw.randrange(60)] = f"v{draw.randrange(400)}"
        yield " ".join(own)


def check(spark, texts, **options):
    sets = [shingles(t) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = roots(len(sets), links)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "source_event_id int, payload string, node string")
    got = {r[0]: tuple(r)[1:] for r in find_near_duplicates(df, **options).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_groups_and_odd_rows(spark):
    texts = [*near_copies(1, 60), *near_copies(2, 8), "", None, " \n", "a b", "A  b", "a b c", "one two three four five", "x y z"]
    texts += [texts[3]] * 5 + ["word " * 50_000, "word " * 40_000]
    check(spark, texts)


def test_hot_buckets_in_small_chunks(spark):
    check(spark, [*near_copies(3, 150), *near_copies(4, 40)], chunk_rows=8)


def test_empty_table_and_null_keys(spark):
    schema = "source_event_id int, payload string"
    assert find_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = find_near_duplicates(spark.createDataFrame([(None, "a b"), (7, "a b"), (None, "")], schema)).collect()
    assert {(r.source_event_id, r.component_id, r.kept) for r in got} == {(7, 7, True), (None, 7, False), (None, None, False)}


def test_words_are_told_by_their_letters_only():
    assert word_hashes(b" The\tthe\x0bTHE other ").tolist()[:3] == [word_hashes(b"the")[0]] * 3
    text = " ".join(f"w{i % 70}" for i in range(500))
    assert len(shingle_set(text.encode())) == len(shingles(text))


def test_odd_sketches_estimate_high_similarities():
    texts = list(near_copies(5, 12))
    _, _, folded, whole = describe([t.encode() for t in texts])
    for i in range(12):
        for j in range(i):
            a, b = shingles(texts[i]), shingles(texts[j])
            assert np.bitwise_count(whole[i] ^ whole[j]).sum() <= len(a ^ b)
            ones = np.array([np.bitwise_count(folded[i] ^ folded[j]).sum()])
            assert ones <= BITS and abs(estimate(ones)[0] - len(a & b) / len(a | b)) < 0.2


def test_components_of_paths_and_stars(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(60, i) for i in range(61, 90)] + [(draw.randrange(100, 140), draw.randrange(100, 140)) for _ in range(25)]
    root = roots(140, links)
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted(want.items())
