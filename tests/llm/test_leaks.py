from __future__ import annotations

import random

from plumbline.llm import leaks
from plumbline.llm.leaks import WuManber, item_runs, leaked_items, plain_words

from tests.conftest import rows

ITEM = "Clerk 94962 sorts the quoted storage crate paid with 46276 tokens by three buyers, and voucher 90323 lowers it"


def test_search_against_find():
    rng = random.Random(1)
    for _ in range(60):
        patterns = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))}
        search = WuManber(patterns)
        for _ in range(20):
            text = "".join(rng.choice("abc ") for _ in range(rng.randrange(80)))
            assert search.search(text) == {p for p in patterns if p in text}
    assert WuManber([]).search("abc") == set() and WuManber(["abc"]).search("") == set()


def test_words():
    assert plain_words("Größe,　HELLO —  «wor-ld» ; x​y") == ["grösse", "hello", "world", "xy"]
    assert plain_words("café") == plain_words("CAFÉ") and plain_words("... -") == []


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, __text int")


def test_passages(spark):
    words = ITEM.split()
    texts = [
        "Intro. " + ITEM.upper().replace(" ", "\n") + " end", "x " + " ".join(words[3:15]) + " y", "x " + " ".join(words[3:14]) + " y", " ".join(words[:12]), "pre" + " ".join(words[:12]),
        " ".join(f"«{w}»;" for w in words[2:15]), None, "", "word " * 200_000 + ITEM, " ".join(words[:6] + ["and"] + words[6:14]),
    ]
    items = spark.createDataFrame([(7, ITEM, "x"), (8, ITEM, "x"), (9, "too short", "x"), (10, None, "x"), (None, ITEM, "x"), (7, ITEM, "x")], "item_id long, text string, doc_id string")
    got = rows(leaked_items(documents(spark, texts), items))
    assert got == sorted([(d, i) for d in (0, 1, 3, 5, 8) for i in (7, 8)], key=repr)
    assert leaked_items(documents(spark, []), items).count() == 0
    assert leaked_items(documents(spark, texts), items.limit(0)).count() == 0


def test_against_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 200)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9)))) for i in range(12)]
    docs = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(40)]
    want = []
    for d, text in enumerate(docs):
        have = text.split()
        for i, item in items:
            ask = item.split()
            if any(have[a : a + 4] == ask[b : b + 4] for b in range(len(ask) - 3) for a in range(len(have) - 3)):
                want.append((d, i))
    got = leaked_items(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), run=4)
    assert rows(got) == sorted(want, key=repr) and len(item_runs(items, 4)) > 10


def test_blocks_and_passes_find_the_same(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 30])) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 25])) for i in range(40)], "doc_id long, text string")
    want = rows(leaked_items(docs, items))
    monkeypatch.setattr("plumbline.llm.leaks.BLOCK_CHARS", 500)
    monkeypatch.setattr("plumbline.llm.leaks.PASS_BLOCKS", 2)
    assert rows(leaked_items(docs, items)) == want and len(want) > 40
