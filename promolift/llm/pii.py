"""Personal data in texts, plain and disguised, as spans of the source.

Plain identifiers are found in the text as it stands. Disguised ones are found by the same detectors in a normalised
copy: a chain of small transducers replaces look-alike characters, removes invisible ones, and turns spelled digits
and at / dot disguises into the characters they stand for, keeping for every output character the source characters
it came from. Spans found there are mapped back, and those that say more than a plain span are added.

Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long runs without one cost nothing."""
    free = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time from each dotted run of digits, which is read once."""
    for match in _DOTTED.finditer(text):
        parts = match.group().split(".")
        start = match.start()
        while len(parts) >= 4:
            end = start + sum(map(len, parts[:4])) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in parts[:4]):
                yield start, end
            start, parts = end + 1, parts[4:]


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if 12 <= match.end() - match.start() <= 37:
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 9 <= sum("0" <= mark <= "9" for mark in match.group()) <= 15:
            yield match.span()


_DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))

# Letters of other scripts that look like ASCII letters, and marks that look like . -
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУаеорсухіјѕԁһӏЅІЈԚԜѴԛԝѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυχϳϲ" + "ɑɩօսցհո" + "‐‑‒–−․。",
        "ABEKMHOPCTXYaeopcyxijsdhlSIJQWVqwv" + "ABEZHIKMNOPTYXoavikpuxjc" + "aioughn" + "-----..",
    )
)
#: Names of characters that are drawn as one ASCII letter.
_DRAWN = re.compile(
    "(?:LATIN LETTER SMALL CAPITAL|LATIN SMALL LETTER (?:SCRIPT|DOTLESS)|REGIONAL INDICATOR SYMBOL LETTER"
    "|NEGATIVE (?:CIRCLED|SQUARED) LATIN CAPITAL LETTER) ([A-Z])"
)
_INVISIBLE = "­​‌‍⁠﻿"
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT_OF = {word: str(value) for words in _DIGIT_WORDS for value, word in enumerate(words.split())} | {
    "oh": "0",
}
_DIGIT_WORD = "|".join(sorted(_DIGIT_OF, key=lambda word: (-len(word), word)))

_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_WORD}|[0-9])[\s,.-]{{1,2}}){{3,}}(?:{_DIGIT_WORD}|[0-9])(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"({_DIGIT_WORD}|[0-9])|([\s,.-]+)", re.I)
_NUMBER = rf"(?:(?:{_DIGIT_WORD}|[0-9])[\s,-]{{1,2}}){{0,2}}(?:{_DIGIT_WORD}|[0-9]{{1,3}})"
_POINT = r"\s(?:dot|point|punkt|punto)\s"
_SPELLED_IP = re.compile(rf"(?<!\w){_NUMBER}(?:{_POINT}{_NUMBER}){{3}}(?!\w)", re.I)
_IP_PART = re.compile(rf"({_POINT})|({_DIGIT_WORD}|[0-9]+)|([\s,-]+)", re.I)
_POINT_WORDS = {"dot", "point", "punkt", "punto"}
_PLUS = re.compile(rf"(?<!\w)plus\s+(?=(?:{_DIGIT_WORD}|[0-9])(?!\w))", re.I)
_MARKED = re.compile(r"\s{0,3}(?:\(\s?(at|@|dot|\.)\s?\)|\[\s?(at|@|dot|\.)\s?\]|\{\s?(at|@|dot|\.)\s?\}|<(at|dot)>)\s{0,3}", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_BARE = re.compile(
    rf"(?<=[A-Za-z0-9])\s(at)\s(?={_LABEL}(?:(?:\sdot\s|\.){_LABEL})*\sdot\s[A-Za-z])"
    rf"|(?<=[A-Za-z0-9])(\sdot\s)(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])\s?(@)\s?(?={_LABEL}(?:(?:\sdot\s|\.){_LABEL})*(?:\sdot\s|\.)[A-Za-z])",
    re.I,
)
_NAMED = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s+at\s+(?=(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?!\w))", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# What makes a word before " at " and a domain a name, and words that are none.
_CUE = re.compile(
    r"\b(?:e-?mails?|mail|write|contact|reach|send|address|kontakt|schreib\w*|adresse|correo|escrib\w*|contacto|courriel"
    r"|écri\w*|contacte\w*)\b",
    re.I,
)
_PROVIDER = re.compile(r"(?:gmail|googlemail|yahoo|hotmail|outlook|icloud|gmx|proton|protonmail|aol|live|msn)\.", re.I)
_NO_NAMES = set("us me him her them you it is be was were are look see met meet here there uns mich ihn nous moi nos".split())


class Normalised(NamedTuple):
    """A text and, per character, the source characters [start, end) it stands for."""

    text: str
    start: np.ndarray
    end: np.ndarray


def _plain(text: str) -> Normalised:
    place = np.arange(len(text) + 1, dtype=np.int32)
    return Normalised(text, place[:-1], place[1:])


def _rewritten(source: Normalised, edits: list[tuple[int, int, str]]) -> Normalised:
    """Apply (start, end, replacement) edits, none of them empty, in order and without overlap."""
    if not edits:
        return source
    pieces, done = [], 0
    for start, end, new in edits:
        pieces += [source.text[done:start], new]
        done = end
    pieces.append(source.text[done:])
    starts, ends, lengths = np.array([(start, end, len(new)) for start, end, new in edits], np.int64).T
    # How often each source character is repeated, and the last one that its copies stand for.
    edge = np.zeros(len(source.text) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    copies = 1 - np.cumsum(edge[:-1], dtype=np.int64)
    copies[starts] = lengths
    last = np.arange(len(source.text))
    last[starts] = ends - 1
    return Normalised("".join(pieces), np.repeat(source.start, copies), np.repeat(source.end[last], copies))


def _ascii_of(mark: str) -> str:
    """The ASCII character that a character looks like, itself if none; nothing for invisible ones."""
    if mark in _INVISIBLE:
        return ""
    if mark in _LOOKALIKES:
        return _LOOKALIKES[mark]
    digit = unicodedata.digit(mark, None)
    if digit is not None:
        return str(digit)
    drawn = _DRAWN.fullmatch(unicodedata.name(mark, ""))
    if drawn:
        return drawn.group(1).lower()
    plain = unicodedata.normalize("NFKC", mark)
    return plain if len(plain) == 1 and plain.isascii() else mark


@lru_cache(maxsize=1)
def _odd() -> tuple[np.ndarray, dict[str, str]]:
    """All characters that look like others, from U+00A1 on: whether a code point is one, and what they look like."""
    wide = ((0x3400, 0xA000), (0xAC00, 0xE000))  # Han and Hangul, private characters
    points = (point for point in range(0xA1, 0x1FBFF) if not any(low <= point < high for low, high in wide))
    found = {mark: plain for mark in map(chr, points) if (plain := _ascii_of(mark)) != mark}
    table = np.zeros(0x110000, bool)
    table[[ord(mark) for mark in found]] = True
    return table, found


def _odd_edits(text: str) -> list[tuple[int, int, str]]:
    """By one table of code points: a pattern of all these characters tries its ranges one by one at each place."""
    table, found = _odd()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return [(at, at + 1, found[text[at]]) for at in np.flatnonzero(table[points]).tolist()]


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        for part in _SPELLED_PART.finditer(text, *run.span()):
            word = part.group(1)
            new = " " if word is None else _DIGIT_OF.get(word.lower(), word)
            if new != part.group():
                edits.append((*part.span(), new))
    return edits


def _ip_edits(text: str) -> list[tuple[int, int, str]]:
    """Four spelled numbers between points become digits without anything else between them."""
    edits = []
    for run in _SPELLED_IP.finditer(text):
        for part in _IP_PART.finditer(text, *run.span()):
            point, digits, _ = part.groups()
            new = "." if point else _DIGIT_OF.get(digits.lower(), digits) if digits else ""
            if new != part.group():
                edits.append((*part.span(), new))
    return edits


def _mark_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for match in _MARKED.finditer(text):
        word = next(group for group in match.groups() if group).lower()
        edits.append((*match.span(), "@" if word in ("at", "@") else "."))
    return edits


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    return [
        (*match.span(), "." if match.group(2) else "@") for match in _BARE.finditer(text) if match.group() != "@"
    ]


def _named_edits(text: str) -> list[tuple[int, int, str]]:
    """`` at `` between a name and a dotted domain whose last label is a word.

    A word is a name if it holds a digit or a mark, if the domain is a mail provider's, or if a word that speaks of mail
    stands shortly before it; pronouns and some verbs are none.
    """
    edits = []
    for match in _NAMED.finditer(text):
        before = text[max(0, match.start() - 112) : match.start()]
        name = _NAME.search(before[-64:]).group()
        if name.lower() in _NO_NAMES:
            continue
        marked = any(not mark.isalpha() for mark in name)
        if marked or _PROVIDER.match(text, match.end()) or _CUE.search(before[: len(before) - len(name)][-48:]):
            edits.append((*match.span(), "@"))
    return edits


def _has_digit_words(words: list[str]) -> bool:
    """Whether four digits, one of them a word, stand in a row."""
    row = spelled = 0
    for word in words:
        if word in _DIGIT_OF:
            row, spelled = row + 1, spelled + 1
        elif len(word) == 1 and word.isdecimal():
            row += 1
        else:
            row = spelled = 0
        if row >= 4 and spelled:
            return True
    return False


def normalised(text: str) -> Normalised:
    """Through all transducers: look-alikes, spelled addresses and digits, marked and bare disguises.

    The words of the text tell which of them have anything to do.
    """
    out = _plain(text)
    out = _rewritten(out, _odd_edits(out.text)) if not out.text.isascii() else out
    words = out.text.lower().replace(",", " ").replace(".", " ").replace("-", " ").split()
    known = set(words)
    if not known.isdisjoint(_POINT_WORDS) and not known.isdisjoint(_DIGIT_OF):
        out = _rewritten(out, _ip_edits(out.text))
    if not known.isdisjoint(_DIGIT_OF) and _has_digit_words(words):
        out = _rewritten(out, _digit_edits(out.text))
    if "plus" in known:
        out = _rewritten(out, [(*match.span(), "+") for match in _PLUS.finditer(out.text)])
    if any(mark in out.text for mark in "([{<"):
        out = _rewritten(out, _mark_edits(out.text))
    if "dot" in known or "@" in out.text:
        out = _rewritten(out, _bare_edits(out.text))
    if "at" in known:
        out = _rewritten(out, _named_edits(out.text))
    return out


def find(text: str | None) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, plain) by start, then kind as in ``KINDS``, then end."""
    text = text or ""
    out = []
    other = normalised(text)
    for kind, detector in _DETECTORS.items():
        plain = list(detector(text))
        out += [(start, kind, end, True) for start, end in plain]
        if other.text != text:
            firsts = np.array([start for start, _ in plain], np.int64)
            for a, b in detector(other.text):
                start, end = int(other.start[a]), int(other.end[b - 1])
                at = int(np.searchsorted(firsts, start, side="right")) - 1
                if at < 0 or plain[at][1] < end:
                    out.append((start, kind, end, False))
    return sorted(set(out), key=lambda span: (span[0], KINDS.index(span[1]), span[2]))


_SPANS = "array<struct<kind: string, start: int, end: int, plain: boolean>>"


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])
    for batch in slices(batches):
        spans = [
            [{"kind": kind, "start": start, "end": end, "plain": plain} for start, kind, end, plain in find(text)]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(span))], ["id", "spans"])


def personal_data(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: id and spans (kind, start, end, plain).

    Null and empty texts have no spans; repeated rows stay; ids may be null; other columns, whatever their names, are
    not read; an empty table gives an empty result.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, _find_all, f"id long, spans {_SPANS}")
