"""The corpus pipeline, stage by stage, on documents with a known fate."""

import random

import pytest

import corpus_pipeline
from shotspark.session import durable

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(draw, n):
    part = "th er on an in ea re nd ou st ti es ble wh".split()
    return " ".join("".join(draw.choices(part, k=draw.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    path = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(draw, 20)) for i in range(5)]
    clean = {i: prose(draw, 60) for i in range(40)}
    junk = {100 + i: prose(draw, 60).upper().replace(" ", "!! ") for i in range(20)}
    copies = {200 + i: clean[i] if i % 2 else clean[i] + " End." for i in range(6)}
    leaks = {300 + i: f"{prose(draw, 30)} {item} {prose(draw, 30)}" for i, item in items}
    private = {400: prose(draw, 40) + " Mail a.b@mail.example.com now. " + prose(draw, 20)}
    docs = [(i, t, "en", "s", len(t)) for part in (clean, junk, copies, leaks, private) for i, t in part.items()]
    docs += [(500, None, None, None, None), (None, prose(draw, 60), "en", "s", 1), (0, clean[0], "en", "s", len(clean[0]))]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*clean, *junk]], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, folder))
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "personal data":
            texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
        docs = out
    good = [*range(40), *range(200, 206), *range(300, 305), 400, 500, None, 0]
    order = lambda ids: sorted(ids, key=str)
    assert order(kept["quality classifier"]) == order(good)
    single = [*range(40), *range(300, 305), 400, 500, None]
    assert order(kept["near-duplicates"]) == order(single)
    apart = [i for i in single if i is None or not 300 <= i < 305]
    assert order(kept["benchmark decontamination"]) == order(kept["personal data"]) == order(apart)
    assert "<email>" in texts[400][0] and "@" not in texts[400][0] and len(texts[400][0]) == texts[400][1]
    assert texts[500] == (None, None)
    assert set(kept["packing"]) == set(apart)


def test_run_is_the_stages_in_a_row(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert len(tokens) == 43 and tokens[500] == 1
    assert corpus_pipeline.ORACLE_SQL is None
