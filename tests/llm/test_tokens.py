from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm.tokens import CorpusEncoder, PrefixEncoder, encode_documents, read_ranks, vocabulary_path

PLACE = vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PLACE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encode():
    return CorpusEncoder(PLACE)


def plain_bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the pair of the lowest rank until there is none."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in pieces]
        pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]


def test_tiny_vocabulary_against_merging():
    ranks = {bytes([b]): b for b in range(256)}
    for t in (b"ab", b"bc", b"abc", b"aa", b"aaa", b"cab", b"bcab", b"aab"):
        ranks[t] = len(ranks)
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(3000)}
    for word, ids in PrefixEncoder(ranks).encode(words):
        assert ids == plain_bpe(word, ranks), word


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_against_merging(text):
    encode = test_any_text_against_merging.encode = getattr(test_any_text_against_merging, "encode", None) or CorpusEncoder(PLACE)
    ranks = test_any_text_against_merging.ranks = getattr(test_any_text_against_merging, "ranks", None) or read_ranks(PLACE)
    want = [i for w in encode.split(text) for i in plain_bpe(w.encode("utf-8", "surrogatepass"), ranks)]
    assert list(next(encode([text]))) == want


def test_against_another_library(encode):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", " ", "Hello  world\n\n x", "It's 12,345.60 원!", "<|endoftext|> ok", "호스 릴 목록으로", "最近見た商品「ホース」", "é‍👩🏽‍🔧", "a" * 3000, "\t \r\n", "ａｂｃ Ⅳ ½", "don'T we'LL"]
    assert [list(x) for x in encode(texts)] == [t.ids for t in other.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, encode):
    long = "한국어 문장 12345 " * 20_000 + "漢" * 30_000
    df = spark.createDataFrame([(1, "Hello", "x"), (2, "", "x"), (3, None, "x"), (None, "Hello", "x"), (1, "Hello", "x"), (4, long, "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_documents(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got[:2] == [(1, [15496])] * 2 and got[2:4] == [(2, []), (3, [])] and got[5] == (None, [15496])
    assert got[4] == (4, list(next(encode([long]))))
    assert encode_documents(df.limit(0)).collect() == []
    assert encode_documents(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("plumbline.llm.tokens.REMEMBERED", 3)
    small, texts = CorpusEncoder(PLACE), ["one two three four", "five six two", "two two one"]
    assert [list(next(small([t]))) for t in texts] == [list(x) for x in CorpusEncoder(PLACE)(texts)]
