"""Quality scores: held-out accuracy, and rows that teach nothing."""

import random

from shotspark.llm.quality import FEATURES, keep_preferred, score_payloads, text_features


def corpus(n):
    draw = random.Random(5)
    words = "the and of lorem ipsum dolor sit amet vero eos stet clita kasd".split()
    for i in range(n):
        text = " ".join(draw.choices(words, k=draw.randrange(20, 90))).capitalize() + "."
        good = i % 3 > 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w + draw.choice(("###", "$$$")) for w in text.split())
        yield f"e{i}", text, int(good)


def test_held_out_rows_are_told_apart(spark):
    rows = list(corpus(300))
    records = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "source_event_id string, payload string, features string")
    labels = spark.createDataFrame([(k, q) for i, (k, _, q) in enumerate(rows) if i % 2], "source_event_id string, quality int")
    truth = {k: q for k, _, q in rows}
    got = score_payloads(records, labels).collect()
    assert len(got) == 300
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(truth[r.source_event_id] == r.predicted for r in got) >= 297
    kept = keep_preferred(records, labels)
    assert kept.columns == records.columns
    assert {r.source_event_id for r in kept.collect()} == {r.source_event_id for r in got if r.predicted}


def test_odd_rows(spark):
    records = spark.createDataFrame(
        [("a", None), ("a", ""), (None, "x"), ("b", "word " * 200_000)], "source_event_id string, payload string"
    )
    nothing = spark.createDataFrame([("a", None), ("z", 1), (None, 0), ("b", 7)], "source_event_id string, quality int")
    got = score_payloads(records, nothing).collect()
    assert len(got) == 4 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert score_payloads(records.limit(0), nothing).count() == 0
    assert keep_preferred(records, nothing).count() == 4


def test_features_have_names_and_fixed_length():
    assert len(text_features("")) == len(text_features("Ab. c")) == len(FEATURES)


def test_copies_do_not_fill_the_sample(spark):
    texts = {1: "A plain text of words, as people write it.", 0: "XX## YY$$ ZZ!! 00 11 22"}
    rows = [(f"e{i}", texts[i % 2], i % 2) for i in range(400)]
    records = spark.createDataFrame([r[:2] for r in rows], "source_event_id string, payload string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "source_event_id string, quality int")
    got = {r.source_event_id: r.predicted for r in score_payloads(records, labels, sample_rows=60).collect()}
    assert got == {k: q for k, _, q in rows}
