from __future__ import annotations

import random

import numpy as np
from plumbline.llm.spans import SharedSpans, agreement, code_points, paragraphs_around, shared_spans, signatures, sliding_minimum, surroundings, window_hashes

from tests.conftest import rows

SHAPE = "doc_id long, text string, rep string, sigs int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SHAPE)


def brute(texts, span):
    pairs, shared = set(), {}
    windows = [{t[i : i + span] for i in range(len(t) - span + 1)} if t else set() for t in texts]
    for a in range(len(texts)):
        covered = set()
        for b in range(len(texts)):
            if a != b and windows[a] & windows[b]:
                pairs.add((min(a, b), max(a, b)))
                covered |= {j for i in range(len(texts[a]) - span + 1) if texts[a][i : i + span] in windows[b] for j in range(i, i + span)}
        shared[a] = len(covered)
    return pairs, shared


def random_texts(rng, n, span):
    pool = ["".join(rng.choice("abcdefgh한글漢😀") for _ in range(rng.randrange(span - 6, 3 * span))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choice("xyz가나") for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            cut = rng.randrange(len(p))
            parts += [p[cut:] if rng.random() < 0.5 else p, "".join(rng.choice("xyz") for _ in range(rng.randrange(9)))]
        texts.append("".join(parts))
    return [*texts, None, "", texts[0], texts[1], pool[0], pool[0], "q" * 90, "q" * 70]


def test_pairs_shares_and_clusters_against_brute_force(spark):
    span, rng = 30, random.Random(3)
    texts = random_texts(rng, 40, span)
    found = SharedSpans(frame(spark, texts), span=span, shingle=20)
    pairs, shared = brute(texts, span)
    assert set(rows(found.pairs())) == pairs and len(pairs) > 30
    assert found.pairs().count() == len(pairs)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in found.shares().collect()}
    assert got == {i: (None if t is None else len(t), shared[i]) for i, t in enumerate(texts)}
    parent = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.doc_id: r.cluster for r in found.clusters().collect()} == {i: parent[i] for p in pairs for i in p}


def test_every_shared_span_collides():
    rng = random.Random(4)
    for _ in range(60):
        core = "".join(rng.choice("ab漢") for _ in range(30))
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(2))
        assert set(signatures(a + core, 30, 20)) & set(signatures(core + b, 30, 20))


def test_hash_windows():
    points = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 3], np.uint32)
    for length in range(1, 11):
        h = window_hashes(points, length)
        same = [[points[i : i + length].tolist() == points[j : j + length].tolist() for j in range(len(h))] for i in range(len(h))]
        assert (h[:, None] == h[None, :]).tolist() == same
    assert len(window_hashes(points, 11)) == 0
    values = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for w in (1, 2, 7, 57, 90):
        assert sliding_minimum(values, w).tolist() == [min(values[i : i + w]) for i in range(max(1, len(values) - w + 1))]


def test_border_of_300(spark):
    core = "".join(chr(0xAC00 + i * 37 % 11000) for i in range(300))
    texts = ["a" + core + "b", "c" + core + "d", "e" + core[1:] + "f", core[:299] + "z", core, core, "w" * 200_000 + core]
    got = set(rows(SharedSpans(frame(spark, texts)).pairs()))
    assert got == {(a, b) for a in (0, 1, 4, 5, 6) for b in (0, 1, 4, 5, 6) if a < b}


def test_copies_and_empty_tables(spark):
    text = "b" * 150 + "c" * 200
    df = spark.range(300).selectExpr("id AS doc_id", f"if(id < 200, '{text}', concat('short', id)) AS text")
    found = SharedSpans(df)
    assert found.pairs().count() == 200 * 199 // 2
    assert found.shares().where("share = 1.0").count() == 200 and found.shares().where("share = 0.0").count() == 100
    assert found.clusters().where("keep").count() == 1
    none = SharedSpans(frame(spark, []))
    assert none.pairs().count() == none.shares().count() == none.clusters().count() == 0
    repeated = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert SharedSpans(repeated).pairs().count() == 0


def test_spans_of_one_pair():
    a, b = "xx" + "p" * 9 + "Q1Q2" * 5 + "yy" + "R3R4" * 5, "Q1Q2" * 5 + "--" + "R3R4" * 5
    in_a, in_b = shared_spans(a, b, 12)
    assert in_a == [(11, 31), (33, 53)] and in_b == [(0, 20), (22, 42)] and shared_spans("abc", "abd", 3) == ([], [])


def test_hot_signatures_are_refined(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.spans.HOT", 2)
    span, rng = 30, random.Random(8)
    for _ in range(2):
        texts = random_texts(rng, 40, span)
        found = SharedSpans(frame(spark, texts), span=span, shingle=20)
        pairs, shared = brute(texts, span)
        assert set(rows(found.pairs())) == pairs and len(pairs) > 30
        assert {r.doc_id: r.shared_chars for r in found.shares().collect()} == shared


def test_boilerplate_shorter_than_a_span_costs_no_pairs(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghij 가나다") for _ in range(280))
    letters = "klmnopqrstuvwxyz라마바"
    other = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [other(150) + line + other(150) for _ in range(400)]
    texts[7] = texts[3][100:460] + other(40)
    found = SharedSpans(frame(spark, texts))
    assert rows(found.pairs()) == [(3, 7)]


def test_paragraphs_meet_once():
    rng = random.Random(10)
    for _ in range(300):
        core = "".join(rng.choice("ab") for _ in range(rng.randrange(5, 14)))
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) + core + "".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        for gram in {a[i : i + 5] for i in range(len(a) - 4)} & {b[i : i + 5] for i in range(len(b) - 4)}:
            wanted = window_hashes(code_points(gram), 5).view(np.int64)
            rows_a, rows_b = (set(zip(*(x.tolist() for x in paragraphs_around(t, wanted, 8, 5)), strict=True)) for t in (a, b))
            meet = any(ka == kb and (fa != fb or fa == -1) for ka, fa in rows_a for kb, fb in rows_b)
            share = any(gram in a[i : i + 8] and a[i : i + 8] in b for i in range(len(a) - 7))
            assert meet == share, (a, b, gram)


def test_surroundings():
    for text, starts in (("q" * 5000, [(0, 4970)]), ("ab" * 40, None), ("x" * 10 + "q" * 29, None)):
        grams = np.unique(window_hashes(code_points(text), 20)).view(np.int64)
        found = surroundings(text, grams, 30, 20)
        assert len(found) <= 14 and (starts is None or [r for f in found for r in f.starts] == starts), (text[:20], found)
        assert all(text[s : s + 20] == f.shown[f.lead : f.lead + 20] for f in found for s, _ in f.starts)
    assert agreement("aXYZb", 1, "cXYZb", 1, 3) == (0, 1) and agreement("aXYZb", 1, "aXYWb", 1, 3) is None and agreement("XYZ", 0, "aXYZ", 1, 3) == (0, 0)


def test_plans_on_both_sides_of_their_bounds_agree(spark, monkeypatch):
    span, rng = 30, random.Random(12)
    texts = random_texts(rng, 30, span)
    want = set(rows(SharedSpans(frame(spark, texts), span=span, shingle=20).pairs()))
    monkeypatch.setattr("plumbline.llm.spans.FETCH_IDS", 0)
    assert set(rows(SharedSpans(frame(spark, texts), span=span, shingle=20).pairs())) == want == brute(texts, span)[0]
