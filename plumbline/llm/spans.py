"""Long spans that occur verbatim in more than one text.

MinHash banding over sliding paragraphs. A paragraph is any stretch of ``span`` code points, its shingles are the stretches
of ``shingle`` code points in it, and its signature is their smallest hash: one band of one row. Neighbouring paragraphs
mostly have the same minimum, so a text keeps about ``2 / (span - shingle + 2)`` signatures for each character. Two
equal paragraphs have equal shingles and collide with certainty, wherever they begin: the recall of candidates is 1, which
bands over paragraphs parted at line breaks cannot give for a span that crosses a break or is a part of a paragraph.
Colliding texts are verified exactly, and clustered by components. For that no text is sent: only the surroundings of those
shingles that collide are, once for each text, and two of them are compared character by character.

A signature of very many texts would join all of them, though they may share no more than a shingle. Such a signature is
refined into the paragraphs around it, which are joined themselves, each pair of texts at the first one they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.graph import connected_components
from plumbline.session import broadcast_if_small, written

#: Code points that make a shared span long.
SPAN = 300
#: Code points of a shingle. Texts are candidates if they share one that is least in its paragraph. Shorter ones make fewer signatures, one
#: for every ``(SPAN - SHINGLE + 2) / 2`` characters, and more candidates that share less than a span.
SHINGLE = 100
#: A signature of more texts than this is refined, so that no bucket costs more than this many pairs for each of its texts.
HOT = 128
#: Up to so many candidate texts their ids are broadcast to the scan that fetches their texts; beyond, it is a join.
FETCH_IDS = 200_000

_U = np.uint64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    h = (left ^ (right >> _U(29))) * _U(0xBF58476D1CE4E5B9) + right * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def window_hashes(points: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every stretch of ``length`` code points, from hashes of half the length; empty if there is none."""
    n = len(points) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = (points.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    power ^= power >> _U(32)
    width, done, result = 1, 0, None
    while True:
        if length & width:
            if result is None:
                result, done = power, width
            else:
                m = len(points) - done - width + 1
                result, done = _join_hashes(result[:m], power[done : done + m]), done + width
        if done == length:
            return result
        m = len(points) - 2 * width + 1
        power = _join_hashes(power[:m], power[width : width + m])
        width *= 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values in linear time; of all values if there are fewer."""
    n = len(values)
    if n <= width:
        return values.min(keepdims=True) if n else values
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def signatures(text: str, span: int = SPAN, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct MinHash signatures of the sliding paragraphs of a text; none for a text shorter than ``span``."""
    points = code_points(text)
    if len(points) < span:
        return np.empty(0, np.int64)
    return np.unique(sliding_minimum(window_hashes(points, shingle), span - shingle + 1)).view(np.int64)


def paragraphs_around(
    text: str, wanted: np.ndarray, span: int = SPAN, shingle: int = SHINGLE, hashes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the paragraphs of a text that hold one of the wanted shingles, and for each what follows the stretch that
    the paragraph before it in the list would need: -1 if the paragraph is the first that two texts can share.

    Around a shingle the paragraphs are taken from the one that reaches farthest to the right to the one that reaches
    farthest to the left. Two texts that share one also share the one before it if the same code point follows; so they
    meet first where different ones follow, or at a paragraph that has none before it: the first of all, or the first that
    fits into the text. Each is given once.
    """
    points, grams, whole = hashes or text_hashes(text, span, shingle)
    most = span - shingle
    rows: set[tuple[int, int]] = set()
    for at in np.flatnonzero(np.isin(grams.view(np.int64), wanted)).tolist():
        for back in range(most + 1):
            start = at - back
            if start < 0:
                break
            if start >= len(whole):
                continue
            end = start + span
            follows = int(points[end]) if back and end < len(points) else -1
            rows.add((int(whole[start]), follows))
    keys = np.array([k for k, _ in rows], np.uint64).view(np.int64)
    return keys, np.array([f for _, f in rows], np.int32)


def text_hashes(text: str, span: int = SPAN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, the hashes of its shingles and of its paragraphs."""
    points = code_points(text)
    return points, window_hashes(points, shingle), window_hashes(points, span)


class Surrounding(NamedTuple):
    """A shingle in a text with all that a span around it needs: ``lead`` characters before it and what follows; and where it is: the
    first and last of consecutive starts."""

    sig: int
    lead: int
    shown: str
    starts: list[tuple[int, int]]


def surroundings(text: str, wanted: np.ndarray, span: int = SPAN, shingle: int = SHINGLE) -> list[Surrounding]:
    """The wanted shingles of a text with their surroundings, equal ones once.

    Of a paragraph that holds a shingle several times its first place counts, so what lies before the place is needed only as
    far as the shingle doesn't occur there. A text of one repeated character has one surrounding, however long it is.
    """
    grams = window_hashes(code_points(text), shingle).view(np.int64)
    most, n = span - shingle, len(text)
    before: dict[int, int] = {}
    found: dict[tuple[int, int, str], list[list[int]]] = {}
    at = np.flatnonzero(np.isin(grams, wanted))
    for place, sig in zip(at.tolist(), grams[at].tolist(), strict=True):
        lead = min(most, place - before.get(sig, -1) - 1)
        before[sig] = place
        if place - lead + span > n:
            continue
        runs = found.setdefault((sig, lead, text[place - lead : place + span]), [])
        if runs and runs[-1][1] == place - 1:
            runs[-1][1] = place
        else:
            runs.append([place, place])
    return [Surrounding(sig, lead, shown, [(a, b) for a, b in runs]) for (sig, lead, shown), runs in found.items()]


def agreement(a: str, lead_a: int, b: str, lead_b: int, shingle: int) -> tuple[int, int] | None:
    """How many characters before and behind a shingle two surroundings have in common; null if the shingles differ."""
    if a[lead_a : lead_a + shingle] != b[lead_b : lead_b + shingle]:
        return None  # a collision of hashes
    tail_a, tail_b = a[lead_a + shingle :], b[lead_b + shingle :]
    return _common(a[:lead_a][::-1], b[:lead_b][::-1]), _common(tail_a, tail_b)


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_spans(a: str, b: str, span: int = SPAN) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of ``a`` and of ``b`` covered by spans of ``span`` or more code points that occur verbatim in both.

    Lists of (start, end), ascending and disjoint. Hashes find the spans; the texts themselves confirm them.
    """
    return _covered(a, b, span), _covered(b, a, span)


def _covered(text: str, other: str, span: int) -> list[tuple[int, int]]:
    here = _hashes(text, span)
    starts = np.flatnonzero(np.isin(here, _hashes(other, span)))
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    firsts = starts[np.concatenate(([0], breaks + 1))]
    lasts = starts[np.concatenate((breaks, [len(starts) - 1]))] + span
    merged: list[tuple[int, int]] = []
    for s, e in zip(firsts.tolist(), lasts.tolist(), strict=True):
        for part in [(s, e)] if text[s:e] in other else [(k, k + span) for k in range(s, e - span + 1) if text[k : k + span] in other]:
            if merged and part[0] <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], part[1]))
            else:
                merged.append(part)
    return merged


@lru_cache(maxsize=8)
def _hashes(text: str, span: int) -> np.ndarray:
    return window_hashes(code_points(text), span)


def signed_texts(documents: DataFrame, *, id_col: str, text_col: str, span: int = SPAN, shingle: int = SHINGLE) -> DataFrame:
    """``text_key, id, n, sigs``: hash, length and signatures of every text of at least ``span`` code points."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("id").isNotNull() & (F.char_length("text") >= span)
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            sigs = [signatures(texts[k].as_py(), span, shingle) for k in range(len(texts))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists], ["text_key", "id", "n", "sigs"])

    keyed = rows.select(F.unhex(F.sha2("text", 256)).alias("text_key"), "id", "text", F.char_length("text").alias("n"))
    return keyed.mapInArrow(sign, f"text_key binary, id {kind}, n int, sigs array<bigint>")


_SPANS = "array<struct<s:int,e:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _verifier(span: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs of surroundings that agree in ``span`` characters around their shingle, with what that covers in both texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, in_a, in_b = [], [], []
            lead_a, lead_b = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            shown_a, shown_b, starts_a, starts_b = batch.column(3), batch.column(6), batch.column(4), batch.column(7)
            for k in range(batch.num_rows):
                same = agreement(shown_a[k].as_py(), lead_a[k], shown_b[k].as_py(), lead_b[k], shingle)
                if same and sum(same) + shingle >= span:
                    keep.append(k)
                    for starts, out in ((starts_a, in_a), (starts_b, in_b)):
                        out.append([{"s": r["s"] - same[0], "e": r["e"] + shingle + same[1]} for r in starts[k].as_py()])
            rows = batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(in_a, _SPANS_ARROW), pa.array(in_b, _SPANS_ARROW)], ["a", "b", "in_a", "in_b"])

    return verify


class SharedSpans:
    """The texts of a corpus that share a span of at least ``span`` code points, found once and read in several ways.

    Null, empty and shorter texts share nothing. Rows with a null id are left out, repeated rows count once, ids are
    expected to name one text each; other columns are ignored. Whole texts are used, of any length.

    ``classes``: the distinct texts: smallest and largest id, length. ``links``: pairs of their representatives with covered parts
    of both, one row or more for each pair. Building it runs jobs: the corpus is read once for its signatures, and once more for the
    surroundings of those that collide; both are written to the shared folder.
    """

    def __init__(
        self, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, shingle: int = SHINGLE
    ) -> None:
        self.documents, self.id_col, self.text_col, self.span = documents, id_col, text_col, span
        self.kind = documents.schema[id_col].dataType.simpleString()
        self.signed = written(signed_texts(documents, id_col=id_col, text_col=text_col, span=span, shingle=shingle))
        # Copies have equal signatures: those of any of them are used.
        self.classes = written(
            self.signed.groupBy("text_key").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sigs").alias("sigs"))
        )
        bands = self.classes.select("rep", F.explode("sigs").alias("sig")).repartition("sig")
        # Signatures of one text only can't collide; most are, and leave here. Both uses read one exchange.
        counts = bands.groupBy("sig").agg(F.count("*").alias("texts")).where("texts > 1")
        met = written(bands.join(counts, "sig").select("sig", "rep", (F.col("texts") > HOT).alias("hot")))
        wanted = met.groupBy("rep").agg(F.collect_list("sig").alias("sigs"))  # as many signatures as a text has, at most
        around = written(self._surroundings(wanted, shingle))
        side = lambda x: around.select("sig", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("lead", "shown", "starts")])
        hot = met.where("hot").select("sig", "rep")
        few = around.join(hot.select("sig").distinct(), "sig", "left_anti") if hot.limit(1).count() else around
        fields = ["a", "b", "lead_a", "shown_a", "starts_a", "lead_b", "shown_b", "starts_b"]
        left = few.select("sig", F.col("rep").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("lead", "shown", "starts")])
        right = few.select("sig", F.col("rep").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("lead", "shown", "starts")])
        met_texts = left.join(right, "sig").where("a < b").select(*fields)
        if few is not around:
            triples = written(self._refined(hot.groupBy("rep").agg(F.collect_list("sig").alias("sigs")), shingle).distinct())
            met_texts = met_texts.unionByName(triples.join(side("a"), ["sig", "a"]).join(side("b"), ["sig", "b"]).select(*fields))
        self.links = met_texts.mapInArrow(_verifier(span, shingle), f"a {self.kind}, b {self.kind}, in_a {_SPANS}, in_b {_SPANS}")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """``rep, text, sigs`` of the texts that ``wanted`` names (``rep, sigs``), read from the corpus."""
        texts = self.documents.select(F.col(self.id_col).alias("rep"), F.col(self.text_col).cast("string").alias("text"))
        some = texts.where(F.col("rep").isNotNull() & (F.char_length("text") >= self.span))
        return some.join(broadcast_if_small(wanted, "rep", FETCH_IDS), "rep").select("rep", "text", "sigs")

    def _surroundings(self, wanted: DataFrame, shingle: int) -> DataFrame:
        """``sig, rep, lead, shown, starts``: :func:`surroundings` of the wanted signatures of each text, of repeated rows repeatedly."""
        span = self.span

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    found = surroundings(batch.column(1)[k].as_py(), np.array(batch.column(2)[k].as_py(), np.int64), span, shingle)
                    if found:
                        rep = batch.column(0).take(pa.array(np.full(len(found), k)))
                        starts = [[{"s": s, "e": e} for s, e in f.starts] for f in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f.sig for f in found], pa.int64()), rep, pa.array([f.lead for f in found], pa.int32()), pa.array([f.shown for f in found]), pa.array(starts, _SPANS_ARROW)],
                            ["sig", "rep", "lead", "shown", "starts"],
                        )

        return self._texts(wanted).mapInArrow(spread, f"sig bigint, rep {self.kind}, lead int, shown string, starts {_SPANS}")

    def _refined(self, hot: DataFrame, shingle: int) -> DataFrame:
        """``sig, a, b``: texts with hot signatures that share a paragraph around one, each pair once for a place.

        Members of a paragraph that the same code point follows met at the paragraph before and are not paired again: only
        those are that differ, class by class, and those for which there is none before.
        """
        span = self.span

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py()
                    hashes = text_hashes(text, span, shingle)
                    for sig in set(batch.column(2)[k].as_py()):
                        keys, follows = paragraphs_around(text, np.array([sig], np.int64), span, shingle, hashes)
                        rep = batch.column(0).take(pa.array(np.full(len(keys), k)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), sig)), rep, pa.array(keys), pa.array(follows)], ["sig", "rep", "key", "follows"])

        rows = written(self._texts(hot).mapInArrow(spread, f"sig bigint, rep {self.kind}, key bigint, follows int"))
        classes = rows.select("sig", "key", "follows").distinct()
        ties = classes.select("sig", "key", F.col("follows").alias("fa")).join(classes.select("sig", "key", F.col("follows").alias("fb")), ["sig", "key"]).where(
            (F.col("fa") < F.col("fb")) | (F.col("fa") == -1) & (F.col("fb") == -1)
        )
        both = ties.join(rows.select("sig", "key", F.col("follows").alias("fa"), F.col("rep").alias("a")), ["sig", "key", "fa"]).join(
            rows.select("sig", "key", F.col("follows").alias("fb"), F.col("rep").alias("b")), ["sig", "key", "fb"]
        )
        return both.where("a <> b").select("sig", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def members(self) -> DataFrame:
        """``rep, id``: the class of every document of at least ``span`` code points."""
        return self.signed.select("id", "text_key").distinct().join(self.classes.select("text_key", "rep"), "text_key").select("rep", "id")

    def _ties(self) -> DataFrame:
        """``a, b``: the linked classes, each pair once, and every class of several documents with itself."""
        copied = self.classes.where(F.col("rep") < F.col("last")).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        return self.links.select("a", "b").distinct().unionByName(copied)

    def pairs(self) -> DataFrame:
        """``<id>_a, <id>_b``: all pairs of documents that share a span, the smaller id first.

        Each pair comes from one link of two classes or from one class. Only the result itself is expanded.
        """
        members = self.members()
        both = self._ties().join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(
            members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b"
        )
        return both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select(
            F.least("x", "y").alias(f"{self.id_col}_a"), F.greatest("x", "y").alias(f"{self.id_col}_b")
        )

    def shares(self) -> DataFrame:
        """``<id>, n_chars, shared_chars, share``: for every document how many of its code points lie in spans that
        other documents hold too. A text with a copy is shared as a whole. Null texts have null ``n_chars`` and share
        nothing; the share of an empty text is 0."""
        sides = F.array(F.struct(F.col("a").alias("rep"), F.col("in_a").alias("spans")), F.struct(F.col("b").alias("rep"), F.col("in_b").alias("spans")))
        covered = self.links.select(F.inline(sides)).select("rep", F.inline("spans"))
        copied = self.classes.where(F.col("rep") < F.col("last")).select("rep", F.lit(0).alias("s"), F.col("n").alias("e"))
        parts = covered.unionByName(copied).distinct()
        before = Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0))))
        sums = parts.select("rep", fresh.alias("fresh")).groupBy("rep").agg(F.sum("fresh").alias("shared"))
        shared = self.members().join(sums, "rep").select("id", "shared")
        docs = self.documents.select(F.col(self.id_col).alias("id"), F.char_length(F.col(self.text_col).cast("string")).alias("n_chars"))
        return docs.distinct().join(shared, "id", "left").select(
            F.col("id").alias(self.id_col),
            F.col("n_chars").cast("long").alias("n_chars"),
            F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"),
            _share(F.col("shared"), F.col("n_chars")).alias("share"),
        )

    def clusters(self) -> DataFrame:
        """``<id>, cluster, keep``: the component of every document that shares a span, named by its smallest id; ``keep``
        is true for that document, the others can be removed without losing a shared text entirely."""
        parts = connected_components(self._ties(), "a", "b")
        return self.members().join(parts.withColumnRenamed("node", "rep"), "rep").select(
            F.col("id").alias(self.id_col), F.col("component").alias("cluster"), (F.col("id") == F.col("component")).alias("keep")
        )


def _share(shared: Column, length: Column) -> Column:
    return F.when(shared > 0, F.round(shared / length, 6)).otherwise(F.lit(0.0))
