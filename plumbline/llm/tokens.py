"""Token ids of a whole corpus by a byte-level BPE vocabulary.

Distinct words are visited in byte order, which is the depth-first order of their trie. For every prefix the traversal
keeps the last token of its encoding; a prefix shared with the word before it is not encoded again. The last token of
a prefix is the one token that ends there and may follow the encoding of what precedes it, so no merge list is replayed
for a word: one step for each byte, however long the word.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits a text into words before encoding, as the vocabulary's makers do.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words (and their UTF-8 bytes) whose ids a worker remembers; beyond it the memory is emptied, results stay the same.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, else in ``$PLUMBLINE_TOKENIZERS``, else in the installed package."""
    folder = folder or os.environ.get("PLUMBLINE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes words by walking their trie with the last token of each prefix as the state."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = {i: len(t) for t, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        reachable = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            pieces = self._merge(token, ranks, i)
            if len(pieces) == 1:
                reachable[token] = i
            elif len(pieces) == 2:
                pair = (ranks[pieces[0]], ranks[pieces[1]])
                self.merged[pair] = i
                self.parts[i] = pair
                reachable[token] = i
        self._automaton(reachable)
        self.follows: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _merge(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
        """BPE of a token's bytes with the merges that come before it."""
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best, at = below, -1
            for i in range(len(pieces) - 1):
                rank = ranks.get(pieces[i] + pieces[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """Transitions that find, after each byte, all tokens that end there, longest first."""
        goto: dict[int, int] = {}
        token_at, children = [-1], [[]]
        for token, i in tokens.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in goto:
                    goto[key] = len(token_at)
                    token_at.append(-1)
                    children[node].append(byte)
                    children.append([])
                node = goto[key]
            token_at[node] = i
        fail = array("i", [0]) * len(token_at)
        ends: list[tuple[int, ...]] = [()] * len(token_at)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte in children[node]:
                child = goto[node << 8 | byte]
                back = fail[node]
                while node and back and back << 8 | byte not in goto:
                    back = fail[back]
                fail[child] = goto.get(back << 8 | byte, 0) if node else 0
                mine = token_at[child]
                ends[child] = ((mine, *ends[fail[child]])) if mine >= 0 else ends[fail[child]]
                queue.append(child)
        self.goto, self.fail, self.ends = goto, fail, ends

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undoes merges on both sides of the border, latest first. If at some point the two tokens at the border would
        themselves merge, and earlier than the merge last undone, then BPE would have merged them across the border.
        """
        known = self.follows.get((left, right))
        if known is not None:
            return known
        a, b, undone, good = left, right, len(self.size) + 1, True
        while True:
            both = self.merged.get((a, b))
            if both is not None and both < undone:
                good = False
                break
            # The merge made last of the two is undone first; of one and the same token the left one was made first.
            if a in self.parts and (b not in self.parts or a > b):
                undone, a = a, self.parts[a][1]
            elif b in self.parts:
                undone, b = b + 1, self.parts[b][0]
            else:
                break
        self.follows[left, right] = good
        return good

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its ids, in byte order."""
        goto, fail, ends, size, may_follow = self.goto, self.fail, self.ends, self.size, self.may_follow
        before = b""
        states, last = [0], [-1]
        for word in sorted(set(words)):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for i in range(shared, len(word)):
                byte = word[i]
                key = state << 8 | byte
                while state and key not in goto:
                    state = fail[state]
                    key = state << 8 | byte
                state = goto.get(key, 0)
                states.append(state)
                for token in ends[state]:
                    start = i + 1 - size[token]
                    if not start or may_follow(last[start], token):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for byte {byte}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            before = word
            yield word, ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path))


class CorpusEncoder:
    """Ids of texts; remembers a bounded number of words."""

    def __init__(self, path: str, pattern: str = WORDS) -> None:
        self.encoder = encoder(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, array] = {}
        self.bytes = 0

    def __call__(self, texts: Iterable[str | None]) -> Iterator[array]:
        """Ids of each text; none for an empty and for a null text."""
        parted = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.known, self.bytes = {}, 0
            self.encoder.follows.clear()
        new = {w.encode(): w for words in parted for w in words if w not in self.known}
        for word, ids in self.encoder.encode(new):
            self.known[new[word]] = array("i", ids)
            self.bytes += len(word)
        known = self.known
        for words in parted:
            ids = array("i")
            for w in words:
                ids.extend(known[w])
            yield ids


@lru_cache(maxsize=2)
def _corpus_encoder(path: str, pattern: str) -> CorpusEncoder:
    return CorpusEncoder(path, pattern)


#: Texts are encoded in groups of about so many characters, so that memory does not depend on the texts' lengths.
GROUP_CHARS = 4_000_000


def encode_documents(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = WORDS
) -> DataFrame:
    """``id_col, ids``: the token ids of each text, without special tokens, one row for each input row.

    Empty and null texts have an empty list. The strings of special tokens in a text are ordinary text. Rows with a
    null id are kept, repeated rows are repeated, other columns are ignored. No shuffle: texts are encoded where they
    are read. The vocabulary is read on the driver's machine and sent to every executor as a file of the application.
    """
    place = path or vocabulary_path()
    documents.sparkSession.sparkContext.addFile(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(place))
        encode = _corpus_encoder(sent if os.path.exists(sent) else place, pattern)
        for batch in batches:
            texts = batch.column(1)
            offsets, values, group, chars = array("i", [0]), array("i"), [], 0
            for k in range(len(texts)):
                text = texts[k].as_py()
                group.append(text)
                chars += len(text or "")
                if chars >= GROUP_CHARS or k == len(texts) - 1:
                    for ids in encode(group):
                        values.extend(ids)
                        offsets.append(len(values))
                    group, chars = [], 0
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
