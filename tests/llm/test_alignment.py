"""Alignment of two cuttings: halving against plain merging, tokens against a loop over pairs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shotspark.llm.alignment import align_payloads, align_scenes, overlaps, shared_groups

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), min_size=1, max_size=4))
def test_groups_end_where_both_end(ranges):
    ends_a, ends_b, roots, base = [], [], [], 0
    for a, b in ranges:
        ends_a += [base + x for x in sorted(a | {41})]
        ends_b += [base + x for x in sorted(b | {41})]
        roots.append(len(ends_a) - 1)
        base += 41
    last = shared_groups(np.array(ends_a), np.array(ends_b), np.array(roots))
    assert [ends_a[i] for i in last] == sorted(set(ends_a) & set(ends_b))
    left, right = overlaps(np.array(ends_a), np.array(ends_b))
    spans = lambda ends: list(zip([0, *ends], ends, strict=False))
    want = [
        (i, k) for i, (s, e) in enumerate(spans(ends_a)) for k, (t, f) in enumerate(spans(ends_b)) if max(s, t) < min(e, f)
    ]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_scenes_of_two_detectors(spark):
    rows = [
        ("v", [9, 19, 29, 49], [19, 24, 30, 49], "x"), ("v", [9], [9], "x"), (None, [4, 9], [9], "x"), ("w", None, [3], "x"),
        ("w", [], [], "x"), ("w", [3, None], [3], "x"), ("w", [3], [4], "x"), ("w", [3, 2, 5], [5], "x"),
    ]
    videos = spark.createDataFrame(rows, "video_id string, ends_a array<bigint>, ends_b array<bigint>, scenes_a string")
    got = [(r.video_id, r.scenes_a, r.scenes_b) for r in align_scenes(videos).collect()]
    want = [("v", [0, 1], [0]), ("v", [2, 3], [1, 2, 3]), ("v", [0], [0]), (None, [0, 1], [0])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert align_scenes(videos.limit(0)).count() == 0


def plain(texts):
    """Every column by a loop over all pairs of overlapping tokens."""
    import sentencepiece

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own}
    letters.update({chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in own)})
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    tokens = []
    for text in texts:
        parts = None
        if text:
            found = a.encode(" " + text, add_special_tokens=False)
            parts = (
                [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in found.ids],
                [(i, spell_b(i)) for i in b.encode(text)],
            )
            if any(b"".join(t for _, t in own) != b" " + text.encode() for own in parts):
                parts = None
        tokens.append(parts)
    linked, out = [], []
    for parts in tokens:
        links, groups, cur = [], [], ([], [])
        if parts:
            i = k = 0
            end_a, end_b = len(parts[0][0][1]), len(parts[1][0][1])
            cur = ([parts[0][0][0]], [parts[1][0][0]])
            while True:
                links.append((parts[0][i][0], parts[1][k][0]))
                done_a, done_b = end_a <= end_b, end_b <= end_a
                if done_a and done_b:
                    groups.append(cur)
                    cur = ([], [])
                i, k = i + done_a, k + done_b
                if i == len(parts[0]):
                    break
                if done_a:
                    end_a += len(parts[0][i][1])
                    cur[0].append(parts[0][i][0])
                if done_b:
                    end_b += len(parts[1][k][1])
                    cur[1].append(parts[1][k][0])
        linked.append(links)
        spelt = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        out.append([len(parts[0]) if parts else 0, len(parts[1]) if parts else 0, len(groups), len(links), spelt])
    count = Counter(p for links in linked for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    for row, links in zip(out, linked, strict=True):
        row[4:4] = [sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links)]
    return [tuple(r) for r in out]


TEXTS = [
    None, "", " ", "a", "The quick brown fox, it's 12:30!\nNaïve café — straße", "two  blanks \n and\ttabs ", " lead", "tail\n",
    "a▁b is not spelt", "<|endoftext|> and </s><0x41> are text", "日本語のテキスト。한국어 русский", "\x00\x01 zero", "emoji 👩‍👩‍👧 end",
    "word word word word", "word word word word", "ab" * 4000, "x y z　w", "'s 't don't we'll",
]


def test_texts_against_a_loop(spark):
    rows = [(f"e{i}" if i % 5 else None, t, -i) for i, t in enumerate(TEXTS)]
    records = spark.createDataFrame(rows, "source_event_id string, payload string, n_a int")
    got = align_payloads(records.repartition(3), BYTES, PIECES, block_bytes=50).collect()
    want = [(r[0], *w) for r, w in zip(rows, plain(TEXTS), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    hashed = align_payloads(records, BYTES, PIECES, digest=True).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted(map(str, map(tuple, hashed))) == sorted(str((*w[:-1], digest(w[-1]))) for w in want)
    assert align_payloads(records.limit(0), BYTES, PIECES).count() == 0
