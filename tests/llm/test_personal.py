"""Personal data: base matches as plain regular expressions give them, and what is learnt besides."""

import random
import re

from pyspark.sql import functions as F

from shotspark.llm.personal import BASE, KINDS, find_personal_data, mask_personal_data, posterior, reliabilities

# The base definitions.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = (d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


TEXTS = [
    "mail to a.b+c@mail7.example.com. or x@y@z.org, q@nodot d@e.f_g@h.i", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345", "+1 (017) 555-7713 +49.30.1234567 +1 +12 34 (+)", "", None,
    'key é🙂 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ünd 9807915762804490', "\x01a@b.c\x02 1.1.1.1\x03", "a" * 50_000 + "@",
    "1" * 50_000, "a.b@" * 2000, "+1" * 3000, "x@y" + ".z" * 20_000,
]


def test_base_matches_are_those_of_plain_patterns(spark):
    draw = random.Random(9)
    texts = TEXTS + ["".join(draw.choices("aZ09.@+-() _%é\x01", [3, 2, 8, 5, 6, 4, 3, 3, 1, 1, 4, 1, 1, 1, 1], k=200)) for _ in range(80)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (None, "a@b.c", "c")]
    df = spark.createDataFrame(rows, "source_event_id int, payload string, spans string")
    got = find_personal_data(df).collect()
    assert len(got) == len(rows)
    by = {r.source_event_id: r.spans for r in got}
    for i, text in enumerate(texts):
        want = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(PLAIN[k], text or "") if right(k, m.group(0))]
        assert [(s.kind, s.start, s.stop) for s in by[i] if s.base] == want, text
        order = [(KINDS.index(s.kind), s.start) for s in by[i]]
        assert order == sorted(order)
    assert [(s.kind, texts[6][s.start : s.stop]) for s in by[6] if s.kind == "secret"] == [
        ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")
    ]
    assert find_personal_data(df.limit(0)).count() == 0


def test_masking(spark):
    df = spark.createDataFrame(
        [(1, "é to a@b.cd or 1.2.3.4, bye", "k"), (2, None, "k"), (3, "nothing", "k")], "a int, payload string, _text string"
    )
    got = mask_personal_data(df)
    assert got.columns == df.columns
    assert [r.payload for r in got.orderBy("a").collect()] == ["é to <email> or <ip>, bye", None, "nothing"]


def test_reliable_labelers_are_recognised():
    draw = random.Random(10)
    counts = {}
    for _ in range(3000):
        true = draw.random() < 0.6
        cast = tuple(int(true) if draw.random() < p else int(not true) for p in (0.95, 0.9, 0.85, 0.6, 0.55))
        counts[cast] = counts.get(cast, 0) + 1
    share, rates = reliabilities([(0, cast, n) for cast, n in counts.items()])
    assert abs(share[0] - 0.6) < 0.05
    assert abs(rates[0][0] - 0.95) < 0.05 and rates[0][0] - rates[0][1] > rates[4][0] - rates[4][1]
    assert posterior(share[0], rates, (1, 1, 1, None, None)) > 0.95 > 0.05 > posterior(share[0], rates, (0, 0, 0, 1, None))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "source_event_id int, payload string").withColumn("x", F.lit(1))
    plan = mask_personal_data(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
