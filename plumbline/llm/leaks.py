"""Evaluation texts in a corpus: every document that holds a run of consecutive words of an item.

Multi-pattern search after Wu and Manber. A pattern is the text of one run of words; a table of character blocks says how
far the search may jump, the block at the end of the window selects the patterns that may end there, and those are
compared directly.
"""

from __future__ import annotations

import math
import sys
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an item that a document must hold in a row.
RUN = 12
#: Items are searched in blocks of about so many characters of patterns, and so many blocks in one pass over the corpus, so that the
#: tables of a pass fit into every worker: some 30,000 items of 1,000 characters a pass.
BLOCK_CHARS, PASS_BLOCKS = 4_000_000, 8

# Characters that don't count within a word: punctuation, symbols, controls and marks without width.
_SILENT = {
    c: None
    for c in range(sys.maxunicode + 1)
    if unicodedata.category(chr(c))[0] in "PS" or unicodedata.category(chr(c)) in ("Cf", "Cc") and not chr(c).isspace()
}


def plain_words(text: str) -> list[str]:
    """The words of a text: parted by white space of any kind, canonically composed, case-folded, without punctuation.

    A piece of nothing but punctuation is no word.
    """
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    if folded.isascii():
        folded = folded.translate(_ASCII_SILENT)
    else:
        folded = folded.translate(_SILENT)
    return folded.split()


_ASCII_SILENT = {c: None for c in _SILENT if c < 128}


class WuManber:
    """Searches a text for many patterns at once. Patterns must not be empty."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = sorted(set(patterns))
        if not self.patterns:
            self.least = 0
            return
        self.least = m = min(map(len, self.patterns))
        # Block length by the size of the pattern set, so that most blocks of a text occur in no pattern.
        letters = max(2, len({c for p in self.patterns for c in p}))
        self.block = b = max(1, min(m, math.ceil(math.log(2 * m * len(self.patterns), letters)) + 1))
        self.jump = m - b + 1
        shift: dict[str, int] = {}
        ending: dict[str, list[str]] = defaultdict(list)
        for p in self.patterns:
            for end in range(b, m + 1):
                piece = p[end - b : end]
                if m - end < shift.get(piece, self.jump):
                    shift[piece] = m - end
            ending[p[m - b : m]].append(p)
        self.shift, self.ending = shift, dict(ending)

    def search(self, text: str) -> set[str]:
        """The patterns that occur in ``text``."""
        found: set[str] = set()
        if not self.least:
            return found
        b, m, far, n = self.block, self.least, self.jump, len(text)
        shift, ending = self.shift.get, self.ending
        at = m
        while at <= n:
            piece = text[at - b : at]
            step = shift(piece, far)
            if step:
                at += step
                continue
            start = at - m
            for p in ending.get(piece, ()):
                if text.startswith(p, start):
                    found.add(p)
            at += 1
        return found


def item_runs(items: Iterable[tuple[int, str | None]], run: int = RUN) -> dict[str, set[int]]:
    """Every run of ``run`` consecutive words of the items, as searchable text, with the items that hold it.

    Items with fewer words have none.
    """
    runs: dict[str, set[int]] = defaultdict(set)
    for item, text in items:
        words = plain_words(text) if text else []
        for i in range(len(words) - run + 1):
            runs[f" {' '.join(words[i : i + run])} "].add(item)
    return runs


def _item_blocks(items: DataFrame, id_col: str, text_col: str, run: int) -> Iterator[dict[str, set[int]]]:
    """The items' runs in blocks of bounded size; one partition of the items is on the driver at a time."""
    block: dict[str, set[int]] = {}
    size = 0
    rows = items.select(id_col, F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        for key, owners in item_runs([(item, text)], run).items():
            size += len(key) if key not in block else 0
            block.setdefault(key, set()).update(owners)
        if size >= BLOCK_CHARS:
            yield block
            block, size = {}, 0
    if block:
        yield block


#: The searchers of the last pass that this worker has seen, by the pass's name: a worker runs many tasks of one pass.
_SEARCHERS: dict[str, list[tuple[WuManber, dict[str, set[int]]]]] = {}


def _searchers(name: str, blocks: list[dict[str, set[int]]]) -> list[tuple[WuManber, dict[str, set[int]]]]:
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[name] = [(WuManber(runs), runs) for runs in blocks]
    return _SEARCHERS[name]


def leaked_items(
    documents: DataFrame, items: DataFrame, *, run: int = RUN,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id_col, item_col``: each document with each item of which it holds ``run`` consecutive words.

    Words are those of :func:`plain_words`. Whole texts are searched, of any length. Null and empty texts hold nothing,
    items with fewer words than ``run`` are held by nothing, null ids are left out, repeated rows and items count once.

    The corpus is read where it lies and not shuffled; only found pairs are, to make them distinct. Items are the
    stated query set: their runs pass the driver one partition at a time and go to the workers in blocks of bounded size. Several blocks
    are searched in one pass over the corpus, whose words are made plain once for all of them.
    """
    spark = documents.sparkSession
    kinds = [(n, d.schema[n].dataType.simpleString()) for d, n in ((documents, id_col), (items, item_col))]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds)
    id_type, item_type = documents.select(id_col).limit(0).toArrow().schema.field(0).type, items.select(item_col).limit(0).toArrow().schema.field(0).type
    corpus = documents.select(id_col, F.col(text_col).cast("string").alias("__text")).where(
        F.col(id_col).isNotNull() & (F.length("__text") > 0)
    )
    found = []
    blocks = _item_blocks(items, item_col, item_text_col, run)
    while group := list(islice(blocks, PASS_BLOCKS)):
        shared = spark.sparkContext.broadcast(group)
        name = uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            searchers = _searchers(name, shared.value)
            for batch in batches:
                docs, held = [], []
                texts = batch.column(1)
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    plain = f" {' '.join(plain_words(texts[k].as_py()))} "
                    hits = {i for searcher, runs in searchers for h in searcher.search(plain) for i in runs[h]}
                    held += sorted(hits)
                    docs += [doc] * len(hits)
                yield pa.RecordBatch.from_arrays([pa.array(docs, id_type), pa.array(held, item_type)], [id_col, item_col])

        found.append(corpus.mapInArrow(find, schema))
    if not found:
        return spark.createDataFrame([], schema)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.distinct()
