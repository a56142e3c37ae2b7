"""Character models: probabilities against plain Kneser-Ney sums, answers and rejection."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shotspark.llm.languages import fit_languages, identify_languages, pieces_of, words_of

SYLLABLES = {"aa": "ba ko mi nu ta re so la".split(), "bb": "strn ock wrap quil zeft ympf drux vlo".split(), "cc": "éa ïu où çe ère ûl ôn âge".split()}


def speech(lang, draw, words):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 4))) for _ in range(words))


def corpus(n=90):
    draw = random.Random(5)
    return [(f"e{i}", speech(lang, draw, draw.randrange(5, 60)).capitalize() + ", 12!", lang) for i in range(n) for lang in [draw.choice(sorted(SYLLABLES))]]


def plain_model(texts, order):
    """Recursive interpolated Kneser-Ney with dictionaries, as the textbook has it."""
    counts = {order: Counter()}
    for text in texts:
        for word in words_of(text):
            padded = " " * (order - 1) + word + " "
            counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    letters = len(counts[1])
    tables = {}
    for n, c in counts.items():
        by = Counter(c.values())
        d = by[1] / (by[1] + 2 * by[2]) if by[1] and by[2] else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, k in c.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1
        tables[n] = c, d, total, kinds

    def chance(window):
        n = len(window)
        lower = chance(window[1:]) if n > 1 else 1 / (letters + 1)
        c, d, total, kinds = tables[n]
        context = window[:-1]
        if not total[context]:
            return lower
        return max(c[window] - d, 0) / total[context] + d * kinds[context] / total[context] * lower

    return chance, [g for g in counts[1]]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_models_equal_the_plain_sums(spark, order):
    rows = corpus()
    records = spark.createDataFrame(rows, "source_event_id string, payload string, lang string")
    models = fit_languages(records, order=order)
    assert models.languages == ("aa", "bb", "cc")
    words = ["bako", "strnock", "éaïu", "x", "komimimimimi", "b" * 200, "日本", "m²k", "²"]
    bits, predicted, letters = models.surprise(words)
    assert predicted.tolist()[:4] == [5, 8, 5, 2] and letters.tolist()[:4] == [4, 7, 4, 1]
    for part in (words[:4], words, words[::-1]):
        # Some words are found again, others go beyond the limit.
        rows_of = dict(zip(part, models.of_words(part, 5), strict=True))
        assert np.allclose([rows_of[w] for w in words if w in rows_of],
                           [[*x, p, n] for w, x, p, n in zip(words, bits, predicted, letters, strict=True) if w in rows_of], rtol=1e-5)
    assert len(models.kept) == 5
    assert (predicted[-1], letters[-1], letters[-2], letters[5]) == (0, 0, 2, 200)
    for k, lang in enumerate(models.languages):
        chance, alphabet = plain_model([t for _, t, x in rows if x == lang], order)
        for word, got in zip(words, bits[:, k], strict=True):
            want = 0.0
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                padded = " " * (order - 1) + part + " "
                want -= sum(np.log2(chance(padded[i : i + order])) for i in range(len(padded) - order + 1))
            assert got == pytest.approx(want, rel=1e-4)
        context = " " * (order - 1)
        assert sum(chance(context + c) for c in [*alphabet, "\0"]) == pytest.approx(1)


def test_long_words_are_cut_without_loss():
    word = "abcdefg" * 40
    pieces = pieces_of(word, 4)
    assert "".join(p[3:] for p in pieces) == word + " " and all(len(p) <= 67 for p in pieces)
    assert [p[:3] for p in pieces[1:]] == [q[-3:] for q in pieces[:-1]]


def test_held_out_rows_and_rejection(spark):
    rows = corpus(300)
    noise = random.Random(2)
    odd = [("n", "".join(noise.choices("qxjzvwkpy", k=400)), "aa"), ("u", "123 ...", "aa"), ("v", None, "bb"), ("w", "", None), (None, "bako miko", None)]
    records = spark.createDataFrame([(k, t, x, i % 3 != 1, 0.5) for i, (k, t, x) in enumerate(rows)] + [(*r, False, 0.5) for r in odd],
                                    "source_event_id string, payload string, lang string, teaches boolean, score double")
    got = identify_languages(records.repartition(4), learn=records.teaches).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    answer = {r.source_event_id: r for r in got}
    assert all(answer[k].lang_pred == x for k, _, x in rows)
    assert sum(answer[k].rejected for k, _, _ in rows) <= 6
    assert answer["n"].rejected and not answer["u"].rejected
    assert [answer[k].lang_pred for k in ("u", "v", "w")] == ["und"] * 3 and answer["u"].score == 0
    assert answer[None].lang_pred == "aa" and answer[None].n_letters == 8


def test_nothing_to_learn(spark):
    records = spark.createDataFrame([("a", "abc", None), ("b", "1", "x")], "source_event_id string, payload string, lang string")
    got = {r.source_event_id: r for r in identify_languages(records.where("lang is null")).collect()}
    assert got["a"].lang_pred == "und"
    assert {r.lang_pred for r in identify_languages(records).collect()} == {"und"}
    assert identify_languages(records.limit(0)).count() == 0


def test_a_row_may_repeat_and_be_very_long(spark):
    text = "bako" * 300_000
    records = spark.createDataFrame([("a", text, "aa"), ("a", text, "aa"), ("b", "strn ock " * 5, "bb")], "source_event_id string, payload string, lang string")
    got = sorted(tuple(r)[:2] for r in identify_languages(records).collect())
    assert got == [("a", "aa"), ("a", "aa"), ("b", "bb")]
