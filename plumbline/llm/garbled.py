"""Text decoded with the wrong character encoding: where it is, and what it was.

For every pair of a true and a wrong encoding the garbled form of each character is computed once, and one multi-pattern
automaton finds all of them, and what is left of lost bytes, in a single pass over a page. Restoring is a decision for a
whole stretch of text: the run of characters around the matches goes back to bytes, and these are read in the true
encoding, from the first byte to the last. Only such runs are replaced, the text around them stays.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.media import decode

# Encodings that text is decoded with by mistake, one byte for each character.
WRONG_SINGLE = ("cp1252", "latin-1", "mac_roman", "iso8859-15", "cp1254", "cp1250", "cp437", "cp850", "cp1251", "koi8-r")
# Encodings with two bytes for a character that UTF-8 is decoded with by mistake.
WRONG_DOUBLE = ("cp949", "cp932", "gbk", "big5")
# Encodings of Korean, Japanese and Chinese text that is read one byte for each character by mistake.
TRUE_DOUBLE = ("euc-kr", "euc-jp", "cp932", "gbk", "big5")
# One-byte encodings of Cyrillic and Greek text that is read as a western one by mistake.
TRUE_SINGLE = ("cp1251", "koi8-r", "cp1253")

#: Characters whose garbled forms are computed: accented Latin letters and signs, controls (what twice garbled text passes
#: through), punctuation, Greek, Cyrillic, CJK punctuation, kana, full-width forms, ideographs and Hangul syllables.
_LATIN = [*range(0x80, 0x180), 0x192, 0x2C6, 0x2DC, *range(0x2010, 0x203B), 0x20AC, 0x20A9, 0x2122, 0x2190, 0x2192]
_EAST = [*range(0x386, 0x3CF), *range(0x400, 0x460), 0x490, 0x491]
_WIDE = [*range(0x3000, 0x3012), *range(0x3041, 0x30FF), *range(0xFF01, 0xFF5F), *range(0x4E00, 0x9FA6), *range(0xAC00, 0xD7A4)]
#: Code pages that agree in most characters; matches of one of them speak for all.
_WEST = ("latin-1", "cp1252", "cp1250", "iso8859-15", "cp1254")
#: Letters of these wrong readings occur in good Cyrillic text, so that a single short match proves nothing.
_LETTERS = ("cp1251", "koi8-r")

#: A strong form is proof by itself, a weak one only beside another of its kind, one in a word only between small letters.
#: A lost one stands for bytes that could not be decoded, or is a control character that no text has.
LOST, STRONG, WEAK, IN_WORD = 3, 2, 1, 0
_LOST = ("\ufffd", *map(chr, [*range(0x80, 0x85), *range(0x86, 0xA0)]))
#: Nothing without these can be garbled: every other form has a character beyond ASCII followed by another, or is within a word.
_SUSPECT = re.compile("[^\x00-\x7f가-힣ぁ-ヿ、。「」][^\x00-\x7f]|[�\x80-\x84\x86-\x9f]|[a-z][一-힣]+[a-z]")


@cache
def _shown(wrong: str) -> list[str]:
    """How a one-byte encoding shows each byte; undefined bytes show as controls, as browsers do."""
    return [bytes([b]).decode(wrong, "ignore") or chr(b) for b in range(256)]


def _read(data: bytes, wrong: str) -> str | None:
    """``data`` as the wrong encoding shows it; null if it is not of a two-byte encoding."""
    if wrong in WRONG_SINGLE:
        table = _shown(wrong)
        return "".join([table[b] for b in data])
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        return None


def _has_sign(shown: str) -> bool:
    return any(unicodedata.category(c)[0] in "SP" for c in shown)


def _double(code: int, true: str) -> bytes | None:
    """A wide character in a two-byte encoding, both bytes beyond ASCII; only Hangul in the Korean one, and none elsewhere."""
    if (0xAC00 <= code <= 0xD7A3) != (true == "euc-kr"):
        return None
    try:
        data = chr(code).encode(true)
    except UnicodeEncodeError:
        return None
    return data if len(data) == 2 and min(data) >= 0x80 else None


def garbled_forms() -> dict[str, tuple[int, str]]:
    """Garbled sequence to (strength, kind); the kind names the true and the wrong encoding.

    Readings as Cyrillic letters count only with a sign among them: look-alike letters in Latin text make all others. A
    two-byte form with a no-break space is none: French text has them behind its letters.
    """
    forms: dict[str, tuple[int, str]] = {c: (LOST, "lost") for c in _LOST}

    def add(shown: str | None, strength: int, true: str, wrong: str) -> None:
        if not shown or shown.isascii() or len(shown) < 2 - (strength == IN_WORD):
            return
        if wrong in _LETTERS and not _has_sign(shown):
            return
        known = forms.get(shown)
        if known is None or known[0] < strength:
            forms[shown] = (strength, sys.intern(f"{true} {'west' if wrong in _WEST else wrong}"))

    for wrong in WRONG_SINGLE:
        for code in _LATIN:
            # An invisible hyphen behind a good letter is a form of damage of its own.
            shown = _read(chr(code).encode(), wrong)
            sure = wrong not in _LETTERS and not shown.endswith("\xad")
            add(shown, STRONG if sure else WEAK, "utf-8", wrong)
        for code in _EAST:
            add(_read(chr(code).encode(), wrong), WEAK, "utf-8", wrong)
        for code in _WIDE:
            add(_read(chr(code).encode(), wrong), STRONG, "utf-8", wrong)
        for true in TRUE_DOUBLE if wrong not in _LETTERS else ():
            for code in _WIDE:
                data = _double(code, true)
                shown = _read(data, wrong) if data else None
                if shown and "\xa0" not in shown:
                    add(shown, WEAK, true, wrong)
    # UTF-8 read two bytes at a time is out of step with its characters: the first four bytes of two characters show as
    # two characters, of which the first is a rare ideograph.
    leads = [(bytes([a, b]), c) for a in range(0xEA, 0xEE) for b in range(0x80, 0xC0) for c in range(0xEA, 0xEE) if not (a == 0xED and b > 0x9E) and not (a == 0xEA and b < 0xB0)]
    kana = [(bytes([0xE3, b]), 0xE3) for b in (0x81, 0x82, 0x83)]
    for wrong in WRONG_DOUBLE:
        for lead, after in [*leads, *kana]:
            for third in range(0x80, 0xC0):
                shown = _read(lead + bytes([third, after]), wrong)
                if shown and len(shown) == 2 and 0x4E00 <= ord(shown[0]) <= 0xFAFF and not 0xAC00 <= ord(shown[0]) <= 0xD7A3:
                    add(shown, STRONG if wrong == "cp949" else WEAK, "utf-8", wrong)
        for lead, _ in kana:
            for third in range(0xA1, 0xC0):
                if wrong == "cp932":
                    add(_read(lead + bytes([third]), wrong), STRONG, "utf-8", wrong)
        for code in range(0xC0, 0x180):  # an accented letter, seen as one ideograph or syllable in the midst of a word
            shown = _read(chr(code).encode(), wrong)
            if shown and len(shown) == 1 and unicodedata.category(shown) == "Lo":
                add(shown, IN_WORD, "utf-8", wrong)
    return forms


@cache
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for shown, (strength, kind) in garbled_forms().items():
        machine.add_word(shown, (len(shown), strength, kind))
    machine.make_automaton()
    return machine


_SMALL_BEFORE, _SMALL_AFTER = re.compile(r"[a-z][\u4e00-\ud7a3]*$"), re.compile(r"[\u4e00-\ud7a3]*[a-z]")


def find_garbled(text: str, first: bool = False) -> list[tuple[int, int, str]]:
    """Garbled spans (start, end, kind), ascending and disjoint; with ``first``, one of them is enough.

    Lost bytes and strong forms are taken, where they overlap the leftmost and longest. Of weak forms those count that touch
    another one of their kind or a strong one, and those in a word that stand between small letters.
    """
    sure: list[tuple[int, int, str]] = []
    weak: list[tuple[int, int, str]] = []
    for last, (size, strength, kind) in _automaton().iter(text):
        start, end = last + 1 - size, last + 1
        if strength >= STRONG:
            sure.append((start, end, kind))
        elif strength == WEAK:
            weak.append((start, end, kind))
        elif _SMALL_BEFORE.search(text, max(0, start - 8), start) and _SMALL_AFTER.match(text, end):
            sure.append((start, end, kind))
        if first and sure:
            return sure
    spans: list[tuple[int, int, str]] = []
    for m in sorted(sure, key=lambda m: (m[0], -m[1])):
        if not spans or m[0] >= spans[-1][1]:
            spans.append(m)
    if not weak:
        return spans
    taken = {i for s, e, _ in spans for i in range(s, e)}
    sides = {(at, kind) for s, e, kind in spans for at in (s, e)}
    runs: list[list[tuple[int, int, str]]] = []
    for m in sorted((m for m in weak if taken.isdisjoint(range(m[0], m[1]))), key=lambda m: (m[0], -m[1])):
        if runs and m[0] < runs[-1][-1][1]:
            continue
        if runs and m[0] == runs[-1][-1][1] and m[2] == runs[-1][-1][2]:
            runs[-1].append(m)
        else:
            runs.append([m])
    proven = [r for r in runs if len(r) > 1 or (r[0][0], r[0][2]) in sides or (r[0][1], r[0][2]) in sides or _is_utf8(text, *r[0])]
    return sorted(spans + [m for run in proven for m in run])


_WIDE_RUN = re.compile("[^\x00-\x7f]+")


def _is_utf8(text: str, start: int, end: int, kind: str) -> bool:
    """Whether a weak form of UTF-8 read two bytes at a time stands in a run of characters that is UTF-8 from end to end."""
    true, wrong = kind.split(" ")
    if true != "utf-8" or wrong not in WRONG_DOUBLE:
        return False
    while start and text[start - 1] > "\x7f":
        start -= 1
    run = _WIDE_RUN.match(text, start).group()
    try:
        return len(run) > 2 and bool(run.encode(wrong).decode())
    except UnicodeError:
        return False


def is_garbled(text: str | None) -> bool:
    """Whether a text shows garbled characters anywhere, restorable or not. Character references count as characters."""
    if not text:
        return False
    if "&" in text:
        text = html.unescape(text)
    if text.isascii() or not _SUSPECT.search(text):
        return False
    return bool(find_garbled(text, first=True))


# ---------------------------------------------------------------- restoring


class Pair(NamedTuple):
    """A true and a wrong encoding: the runs of text that may be its garbled form, and the way back to bytes."""

    true: str
    wrong: str
    runs: re.Pattern[str]
    back: dict[int, int] | None


@cache
def _pairs() -> list[Pair]:
    """All pairs that restoring tries, UTF-8 first."""
    out = []
    for true in ("utf-8", *TRUE_DOUBLE, *TRUE_SINGLE):
        for wrong in WRONG_SINGLE:
            if wrong == true:
                continue
            image = {ord(c): b for b, c in enumerate(_shown(wrong)) if b >= 0x80}
            chars = "[" + "".join(re.escape(chr(c)) for c in image) + "]"
            # The second byte may be an ASCII character in these encodings.
            after = rf"(?:{chars}|[!-~])*" if true in ("cp932", "gbk", "big5") else f"{chars}*"
            out.append(Pair(true, wrong, re.compile(chars + after), image))
        if true == "utf-8":
            out += [Pair(true, wrong, re.compile(r"[^\x00-\x7f][^\x00-\x20]*"), None) for wrong in WRONG_DOUBLE]
    return out


_GOOD_SHORT = {*range(0xA0, 0x180), 0x192, *_EAST}
_LETTERS_OF = {"cp1251": "а-яёіїєґ", "koi8-r": "а-яё", "cp1253": "ά-ώ"}


@cache
def _words_of(true: str) -> re.Pattern[str]:
    """Words as the alphabet of a one-byte encoding writes them: in small letters, with a capital, or all in capitals."""
    small = _LETTERS_OF[true]
    large = small.upper().replace("Ά-Ώ", "Ά-Ϋ")
    return re.compile(f"[{small}{large}]?[{small}]*|[{large}]+")


def _likely(out: str, true: str) -> tuple[float, int] | None:
    """How much better than chance a run is explained by reading its bytes as ``out``: about the logarithm of the odds, summed over
    its characters, and the number of ideographs among them; null if a character can't be meant."""
    odds, ideographs = 0.0, 0
    if true in TRUE_SINGLE:
        if not _words_of(true).fullmatch(out):
            return None
        return sum(1.1 if c.islower() else 0.3 for c in out), 0
    for c in out:
        code = ord(c)
        if code < 0x80:
            if code < 0x20 or code == 0x7F:
                return None
        elif true == "utf-8":
            if code < 0xA0:
                odds += 1.0  # what twice garbled text passes through
            elif code < 0x800:
                if code not in _GOOD_SHORT and not 0x2C6 <= code <= 0x2DC:
                    return None
                odds += 2.3
            elif unicodedata.category(c) in ("Cn", "Co", "Cs"):
                return None
            else:
                odds += 4.0
        elif true == "euc-kr":
            if not (0xAC00 <= code <= 0xD7A3 or 0x3000 <= code <= 0x3015 or c in "·…―℃㎏㎜㎝㎡" or code in _EAST):
                return None
            odds += 1.3 if code >= 0xAC00 else 1.0
        elif 0x3041 <= code <= 0x30FF and true in ("euc-jp", "cp932"):
            odds += 3.0
        elif 0x3000 <= code <= 0x30FF or 0xFF01 <= code <= 0xFF5E or code in _EAST:
            odds += 1.0
        elif 0x4E00 <= code <= 0x9FA5:
            odds += _common(c, true)
            ideographs += 1
        else:
            return None
    return odds, ideographs


def _common(c: str, true: str) -> float:
    """The odds of an ideograph: those of the first level of its character set are common, all others are rare. Odds
    are those of the bytes of a common one among all pairs of bytes."""
    lead, trail = c.encode(true)[:2]
    if true == "gbk":
        return 0.85 if 0xB0 <= lead <= 0xD7 and trail > 0xA0 else -1.0
    low, high, odds = {"euc-jp": (0xB0, 0xCF, 1.08), "cp932": (0x88, 0x97, 1.08), "big5": (0xA4, 0xC6, 0.48)}[true]
    return odds if low <= lead <= high else -1.0


class Reading(NamedTuple):
    """One way to read a stretch of text: what is replaced, and its odds."""

    odds: float
    pair: int
    edits: tuple[tuple[int, int, str], ...]
    ideographs: int


#: Odds that a reading needs, by which it has to exceed every other reading with another result, and how much of that for each
#: ideograph in it (those of one encoding are mostly ideographs in another one too).
LEAST, MARGIN, CERTAIN, FOR_IDEOGRAPH = 2.0, 2.0, 7.0, 0.4
#: Signs of good text that may stand beside a garbled run.
_BESIDE = " ·•…–—“”‘’«»()"


def _back(run: str, pair: Pair) -> str | None:
    """A run in the true encoding; null if any of its bytes is none of it."""
    try:
        data = run.translate(pair.back).encode("latin-1") if pair.back is not None else run.encode(pair.wrong)
        out = data.decode(pair.true)
    except UnicodeError:
        return None
    return out if out != run else None


_JOINED = re.compile("[^\x00-\x7f][a-z]")


def _read_run(text: str, start: int, end: int, pair: Pair) -> tuple[int, int, str, float, int] | None:
    """The run, or what is left of it without good signs at its ends, read in the true encoding, with its odds and ideographs."""
    while start < end:
        run = text[start:end]
        out = _back(run, pair)
        likely = None if out is None else _likely(out, pair.true)
        if likely is not None:
            odds, ideographs = likely
            before, after = text[start - 1 : start], text[end : end + 1]
            if pair.true == "utf-8":
                if before.isascii() and before.islower() and after.isascii() and after.islower() and out[0] >= "\u3041":
                    return None
                if len(before) == 1 and before.islower() and out[0].isupper():
                    odds -= 3.0
                if len(after) == 1 and after.islower() and out[-1].isupper() and (out[-2].islower() if len(out) > 1 else before.islower()):
                    odds -= 3.0
            elif any(c.isalpha() and (pair.true in TRUE_SINGLE or not c.isascii()) for c in (before, after)) or before.islower() or _JOINED.search(out + after):
                return None  # no word is part letters as they are shown, part others
            return start, end, out, odds, ideographs
        if run[0] in _BESIDE:
            start += 1
        elif run[-1] in _BESIDE:
            end -= 1
        else:
            return None
    return None


@lru_cache(maxsize=16384)
def _readings(text: str, proven: bool, quick: bool = False) -> tuple[Reading, ...]:
    """The ways to read a stretch of text in which every garbled span is explained by one pair of encodings; all its runs of that
    pair's characters are read, those that can't be only stay if nothing in them is garbled. Without ``proven`` all runs must be read; with ``quick`` the first way
    by UTF-8 is enough."""
    spans = find_garbled(text) if proven else []
    if proven and not spans or any(kind == "lost" and text[s] == "\ufffd" for s, _, kind in spans):
        return ()
    found: dict[tuple[tuple[int, int, str], ...], Reading] = {}
    for k, pair in enumerate(_pairs()):
        odds, ideographs, edits, left = 0.0, 0, [], False
        for m in pair.runs.finditer(text):
            got = _read_run(text, m.start(), m.end(), pair)
            if got is not None:
                edits.append(got[:3])
                odds, ideographs = odds + got[3], ideographs + got[4]
            elif not proven or pair.true != "utf-8" or _SUSPECT.search(m.group()) or any(s < m.end() and e > m.start() for s, e, _ in spans):
                left = True
                break
        if ideographs > 3 and pair.true in ("euc-jp", "cp932") and not any("\u3041" <= c <= "\u3093" for _, _, new in edits for c in new):
            odds -= 2.0  # Japanese text has kana among so many ideographs
        if left or not edits or odds < ideographs / 2 or any(not any(a <= s and e <= b for a, b, _ in edits) for s, e, _ in spans):
            continue
        key = tuple(edits)
        if key not in found or found[key].odds < odds:
            found[key] = Reading(odds, k, key, ideographs)
        if pair.true == "utf-8" and (quick or odds >= CERTAIN):
            break  # chance doesn't make several characters of UTF-8
    return tuple(sorted(found.values(), reverse=True))


_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def _plain(piece: str) -> tuple[str, list[int] | None]:
    """A piece with its references to characters beyond ASCII as those characters, and where each of its characters starts."""
    if "&" not in piece:
        return piece, None
    out, at, last = [], [], 0
    for m in _REFERENCE.finditer(piece):
        char = html.unescape(m.group())
        if char.isascii():
            continue
        out.append(piece[last : m.start()])
        at += range(last, m.start())
        out.append(char)
        at += [m.start()] * len(char)
        last = m.end()
    if not out:
        return piece, None
    out.append(piece[last:])
    at += range(last, len(piece) + 1)
    return "".join(out), at


def _spliced(piece: str, at: list[int] | None, edits: tuple[tuple[int, int, str], ...]) -> str:
    out, last = [], 0
    for start, end, new in edits:
        start, end = (start, end) if at is None else (at[start], at[end])
        out += [piece[last:start], new]
        last = end
    return "".join([*out, piece[last:]])


_PIECE, _WORD = re.compile(r"([\n\r<>]+)"), re.compile(r"([\s<>]+)")


def restore(text: str | None, by_word: bool = False) -> str | None:
    """``text`` with its garbled stretches in their original characters; text garbled several times is restored as often.

    A stretch is what stands between line breaks and tags (with ``by_word`` between white space, and short words are taken for
    UTF-8: a quick reading for features, not for texts). It is restored as a whole or
    left as it is: it stays if a byte of it was lost, if no pair of encodings explains all that is garbled in it, or if
    several do and neither its own characters nor the rest of the text decide between them. Correct text beside garbled
    runs stays as it is written.
    """
    if not text or (text.isascii() and "&" not in text):
        return text
    shown = html.unescape(text) if "&" in text else text
    if shown.isascii() or not _SUSPECT.search(shown) or not find_garbled(shown, first=True):
        return text
    pieces = (_WORD if by_word else _PIECE).split(text)
    first = list(pieces)
    open_ = [k for k in range(0, len(pieces), 2) if not pieces[k].isascii() or "&" in pieces[k]]
    seen: dict[int, set[str]] = {k: {pieces[k]} for k in open_}
    while open_:
        plain = {k: _plain(pieces[k]) for k in open_}
        ways = {k: _readings(plain[k][0], True, by_word) for k in open_}
        votes: Counter[int] = Counter()
        for found in ways.values():
            for way in found:
                votes[way.pair] += way.odds
        for k in open_:
            if not ways[k] and not find_garbled(plain[k][0], first=True) and len(votes) and not plain[k][0].isascii():
                # Nothing is proven here, but the rest of the text tells which encodings were mistaken.
                ways[k] = tuple(w for w in _readings(plain[k][0], False) if w.odds > 0 and votes[w.pair] >= 4 * CERTAIN and w.pair == max(votes, key=votes.__getitem__))
        again = []
        for k in open_:
            way = _chosen(ways[k], votes)
            if way is None:
                continue
            new = _spliced(pieces[k], plain[k][1], way.edits)
            if new not in seen[k]:
                seen[k].add(new)
                pieces[k] = new
                again.append(k)
        open_ = again
    for k in seen:
        if pieces[k] != first[k] and is_garbled(pieces[k]):
            pieces[k] = first[k]
    return "".join(pieces)


def _chosen(ways: tuple[Reading, ...], votes: Counter[int]) -> Reading | None:
    """The one likely reading; of several the one that the rest of the text speaks for."""
    if not ways or ways[0].odds < (LEAST if len(ways) > 1 else 1.0):
        return None
    best = ways[0]
    near = [w for w in ways if best.odds - w.odds < max(MARGIN, FOR_IDEOGRAPH * best.ideographs)]
    if len(near) == 1:
        return best
    ranked = sorted(near, key=lambda w: votes[w.pair] - w.odds, reverse=True)
    lead = (votes[ranked[0].pair] - ranked[0].odds) - (votes[ranked[1].pair] - ranked[1].odds)
    return ranked[0] if lead >= CERTAIN else None


def garbled_captures(captures: DataFrame, *, restored: bool = True) -> DataFrame:
    """``capture_id, restored``: the captures whose content, decoded as ``media_type`` declares, shows garbled characters,
    with the restored text of the page (null if ``restored`` is false, which spares the work).

    Of repeated deliveries of a capture the one with the latest ``ingested_at`` stands. Null and empty contents show
    nothing; rows with a null id are left out; other columns are ignored. Whole pages are searched, of any length.
    Pages are judged where they are read; a shuffle moves the ids of repeated deliveries and the garbled pages only.
    """
    rows = captures.select("capture_id", "ingested_at", "content", "media_type").where(F.col("capture_id").isNotNull())
    time = rows.schema["ingested_at"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = [], []
            contents, media = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                text = decode(contents[k].as_py(), media[k].as_py())
                shown = is_garbled(text)
                bad.append(shown)
                good.append(restore(text) if shown and restored else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bad, pa.bool_()), pa.array(good, pa.string())],
                ["capture_id", "ingested_at", "garbled", "restored"],
            )

    judged = rows.mapInArrow(judge, f"capture_id string, ingested_at {time}, garbled boolean, restored string")
    latest = judged.groupBy("capture_id").agg(F.max(F.struct("ingested_at", "garbled", "restored")).alias("v"))
    return latest.where("v.garbled").select("capture_id", F.col("v.restored").alias("restored"))
