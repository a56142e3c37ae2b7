"""The registered queries over whole given tables, against plain definitions or SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import test_alignment
import test_loops

import __spark_entry__ as entry
from shotspark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def given(sf):
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, sf, given):
    table = given("embeddings")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = QUERIES["op1_nearest_frames"](spark, sf).toPandas()
    recall = []
    for query in ids[ids % 20 == 0]:
        own = got[got.query_id == query].sort_values("rank")
        scores = x @ x[ids == query][0]
        others = ids != query
        want = ids[others][np.lexsort((ids[others], -scores[others]))[:20]]
        assert own["rank"].tolist() == list(range(1, len(want) + 1)) and (np.diff(own.score) <= 0).all()
        assert np.allclose(own.score, [scores[ids == v][0] for v in own.vec_id])
        recall.append(len(set(want) & set(own.vec_id)) / len(want))
    assert np.mean(recall) >= 0.95


def test_op2_places_every_token_once(spark, sf, given):
    got = QUERIES["op2_pack_scenes"](spark, sf).toPandas()
    assert set(got.doc_id) == set(given("documents").doc_id)
    for _, own in got.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == own.doc_tokens.iloc[0]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 2048


def test_op3_on_held_out_rows(spark, sf, given):
    got = QUERIES["op3_score_quality"](spark, sf).toPandas().merge(given("labels"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = (held[held.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.95
    # The smallest tables leave some fifty labels to learn from.
    assert (held.predicted == held.quality).mean() >= 0.9


def test_op5_finds_every_exact_leak(spark, sf, given):
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    docs = [(i, f" {plain(t)} ") for i, t in zip(given("documents").doc_id, given("documents").text, strict=True)]
    items = [(i, f" {plain(t)} ") for i, t in zip(given("benchmark").item_id, given("benchmark").text, strict=True)]
    want = {(d, i) for d, text in docs for i, item in items if item in text}
    got = QUERIES["op5_find_leaks"](spark, sf).toPandas()
    assert want <= set(zip(got.doc_id, got.item_id, strict=True))
    assert (got.similarity >= 0.75).all()


def test_op7(spark, sf, given):
    length = 400
    docs = [(i, (t or "").encode()) for i, t in zip(given("documents").doc_id, given("documents").text, strict=True)]
    seen = Counter(hashlib.md5(r[k : k + length]).digest() for _, r in docs for k in range(len(r) - length + 1))
    got = QUERIES["op7_remove_passages"](spark, sf).toPandas().set_index("doc_id")
    for i, raw in docs:
        cover = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[hashlib.md5(raw[k : k + length]).digest()] > 1:
                cover[k : k + length] = True
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        assert (got.n_removed[i], got.kept_sha256[i]) == (cover.sum(), hashlib.sha256(kept).hexdigest())


def test_op11(spark, sf, given):
    docs = given("documents")
    want = test_alignment.plain(docs.text.tolist())
    got = QUERIES["op11_align_tokens"](spark, sf).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((r.doc_id, *(r[c] for c in names)) for r in got) == sorted(
        (i, *w[:-1], digest(w[-1])) for i, w in zip(docs.doc_id.tolist(), want, strict=True)
    )


def test_op12_on_held_out_rows(spark, sf, given):
    docs = given("documents")
    got = QUERIES["op12_identify_languages"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    lettered = got.text.fillna("").str.contains(r"[^\W\d_]")
    assert ((got.lang_pred == "und") == ~lettered).all()
    held = got[got.held_out & lettered & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() >= 0.97


def test_op13(spark, sf, given):
    got = {r.doc_id: r for r in QUERIES["op13_find_loops"](spark, sf).collect()}
    docs = given("documents")
    assert len(got) == len(docs)
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    looped = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        # Documents without a repeated window of six words cannot hold a run of twelve.
        windows = [tuple(words[k : k + 6]) for k in range(n - 5)]
        runs = test_loops.plain_runs(words, 12) if len(set(windows)) < len(windows) else []
        looped += bool(runs)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        start, length, period = (best[1], -best[0], best[2]) if best else (None,) * 3
        own = got[i]
        assert (own.n_runs, own.start, own.length, own.period) == (len(runs), start, length, period)
        assert own.exponent_milli == (1000 * length // period if best else None)
        assert own.runs_sha256 == hexed("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert own.collapsed_sha256 == hexed(" ".join(test_loops.plain_once(words, runs)))
    assert looped > 10


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
