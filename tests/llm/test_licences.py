"""License phrases and notices against plain definitions."""

import re

from shotspark.llm.licences import PHRASES, TEMPLATES, TemplateIndex, scan_licences, words_of


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group(0).lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


TEXTS = [
    "Released under the MIT License.", "mit  LICENSE\nmit-license; été", "the MIT, License and the Apache\nlicense general public license",
    "Licensed under CC BY-NC 4.0.", "licensed### under$$$ cc by%%% nc 4 0", "mitlicense", "", None,
    "Licensed under the Apache License, Version 2.0 " * 3, "a b c " * 400 + "this program is licensed under gnu affero general license version 3" + " d e f" * 300,
    "under the law of the", "word " * 100_000,
]


def test_against_plain_definitions(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "c"), (None, "MIT license", "c")]
    df = spark.createDataFrame(rows, "source_event_id int, payload string, n_words string")
    got = scan_licences(df).collect()
    assert len(got) == len(rows)
    by = {r.source_event_id: r for r in got}
    for i, text in enumerate(TEXTS):
        words = plain_words(text or "")
        places = [
            (k, label) for phrase, label in PHRASES.items() for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        starts = [k for k, _ in places]
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(places), min(starts, default=None), max(starts, default=None)
        )
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert by[3].labels == by[4].labels == "cc-by-nc" and by[9].labels == "agpl" and by[10].labels == by[11].labels == ""
    assert scan_licences(df.limit(0)).count() == 0


def test_filters_lose_no_match():
    index = TemplateIndex(TEMPLATES, {w: len(w) for _, t in TEMPLATES for w in words_of(t.encode())}, 0.6)
    tokens = sorted(index.rank.values())
    for step in range(1, 12):
        for size in range(1, 30):
            block = tokens[step::step][:size]
            want = {
                t: len(own & set(block)) / len(own) for t, own in enumerate(index.sets)
                if len(own & set(block)) >= index.need[t]
            }
            assert index.matches(block) == want


def test_notices_wrapped_over_lines():
    index = TemplateIndex(TEMPLATES, {}, 0.8)
    wrapped = {
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
        "apache": "// Licensed under the Apache\n// License, Version\n// 2.0 (the",
    }
    for label, text in wrapped.items():
        for before in ("", "word " * 15 + "\n", "some other text\n\n" * 7):
            assert label in index.best((before + text).encode())


def test_all_notices_of_a_block():
    index = TemplateIndex(TEMPLATES, {}, 0.8)
    text = {label: t for label, t in TEMPLATES}
    labels = lambda *names: set(index.best(". ".join(text[n] for n in names).encode()))
    assert labels("cc-by-sa", "cc0") == {"cc-by-sa", "cc0"}
    assert labels("mpl", "lgpl") == {"mpl", "lgpl"}
    assert labels("bsd", "cc-by") == {"bsd", "cc-by"}
    for label in text:
        assert labels(label) == {label}
