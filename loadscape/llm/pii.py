"""Personal data in text, with offsets into the source even where it is disguised.

Three transducers normalise a text in turn: look-alike characters (and invisible ones, which go), spelled
digits, and at/dot disguises. Each returns the new text with an alignment, so a span found in the last text maps
back to source characters. Spans of the plain text always stay; the transducers only add to them, also where a plain
span is a fragment of what they find.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; every text is
scanned whole in linear time; rows that repeat or share an id, and rows with a null one, are each scanned and reported; of spans as
likely the leftmost counts; no rows give no rows; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    # A match is the longest local part before an @, so look for @ and walk back: linear on any text.
    found, free = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def ips(text: str) -> list[tuple[int, int]]:
    fits = lambda part: len(p := part.lstrip("0")) <= 3 and (not p or int(p) <= 255)
    return [m.span() for m in _IP.finditer(text) if all(map(fits, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Alignment:
    """Maps spans of a rewritten text back to the text it was made from."""

    def __init__(self, edits: list[tuple[int, int, str]]):
        self.source = [(start, end) for start, end, _ in edits]
        self.starts, self.ends, shift = [], [], 0
        for start, end, put in edits:
            self.starts.append(start + shift)
            self.ends.append(start + shift + len(put))
            shift += len(put) - (end - start)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = (bisect.bisect_right(self.starts, pos) - 1 for pos in (start, end - 1))
        if i >= 0:
            start = self.source[i][0] if start < self.ends[i] else self.source[i][1] + start - self.ends[i]
        if j >= 0:
            end = self.source[j][1] + max(0, end - self.ends[j])
        return start, end


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Alignment]:
    out, at = [], 0
    for start, end, put in edits:
        out += (text[at:start], put)
        at = end
    out.append(text[at:])
    return "".join(out), Alignment(edits)


#: Letters of other scripts that look like Latin ones, and signs used for dots, dashes and blanks.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_ODD = re.compile("[ ­ɐ-\U0010ffff]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]+")


class _Plain(dict):
    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = LOOKALIKES.get(char)
        if plain is None:
            digit = unicodedata.digit(char, None)
            plain = str(digit) if digit is not None and code > 127 else unicodedata.normalize("NFKC", char)
            if len(plain) != 1 or ord(plain) > 127:
                plain = char
        self[code] = plain
        return plain


_PLAIN = _Plain()


def homoglyphs(text: str) -> tuple[str, Alignment | None]:
    if text.isascii() or not _ODD.search(text):
        return text, None
    return rewrite(text.translate(_PLAIN), [(*m.span(), "") for m in _INVISIBLE.finditer(text)])


#: The digits' names in English, German, French and Spanish.
DIGIT_NAMES = {
    "zero": "0", "null": "0", "zéro": "0", "cero": "0", "one": "1", "eins": "1", "un": "1", "uno": "1", "two": "2", "zwei": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3", "four": "4", "vier": "4", "quatre": "4", "cuatro": "4", "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "sept": "7", "siete": "7", "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
_NAME = "|".join(sorted((f"[{n[0]}{n[0].upper()}]{n[1:]}" for n in DIGIT_NAMES), key=len, reverse=True))
_DOT_NAME = "dot|point|punkt|punto"
_FIGURE = f"(?:{_NAME}|[0-9]++)(?!\\w)"
_MIXED = re.compile(rf"(?<!\w)(?:[Pp]lus[ -])?{_FIGURE}(?:(?:[ ,-]{{1,2}}|\.| (?:{_DOT_NAME}) ){_FIGURE}){{3,}}")
_ARTICLES = {"un", "uno", "one"}
_TOKEN = re.compile(r"\w+|[ ,-]+")


def spelled_digits(text: str) -> tuple[str, Alignment | None]:
    """Runs of at least four spelled digits, also mixed with figures; what parts them goes, but for a dot, spelled or not."""
    edits = []
    for run in _MIXED.finditer(text):
        words = [m for m in _TOKEN.finditer(text, *run.span())]
        names = [w for m in words if (w := m[0].lower()) in DIGIT_NAMES]
        if len(names) > 1 or names and names[0] not in _ARTICLES:  # one that may be an article tells nothing
            for m in words:
                if not m[0].isdecimal():
                    word = m[0].lower()
                    edits.append((*m.span(), DIGIT_NAMES.get(word) or ("+" if word == "plus" else "." if word in _DOT_NAME.split("|") else "")))
    return rewrite(text, edits) if edits else (text, None)


_AT = "at|AT|arroba|arobase|@"
_DISGUISE = re.compile(rf"[ ]{{0,2}}[\[({{<][ ]?(?:(?P<at>{_AT})|(?P<dot>{_DOT_NAME}|DOT|\.))[ ]?[\])}}>][ ]{{0,2}}")
_HOST = rf"[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}} (?:{_DOT_NAME}) [A-Za-z]{{2,24}}\b"
_BARE = re.compile(rf"(?<=[A-Za-z0-9])(?: (?:at|arroba|arobase) (?={_HOST})|@(?=[A-Za-z0-9]))|(?<=[0-9]) (?P<dot>{_DOT_NAME}) (?=[0-9])")
_BARE_DOT = re.compile(rf" (?:{_DOT_NAME}) ")
_BARE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.| (?:{_DOT_NAME}) )[A-Za-z0-9-]{{1,63}})+")
_BARE_HOST = re.compile(_HOST)
_DOT_BEFORE = tuple(f" {name} " for name in _DOT_NAME.split("|"))


def bracketed(text: str) -> tuple[str, Alignment | None]:
    """Bracketed at and dot anywhere."""
    edits = [(*m.span(), "." if m["dot"] else "@") for m in _DISGUISE.finditer(text)]
    return rewrite(text, edits) if edits else (text, None)


def _dots_before(text: str, at: int, free: int) -> list[tuple[int, int, str]]:
    """Bare dots of the local part that ends at `at`, none before `free`."""
    edits: list[tuple[int, int, str]] = []
    while True:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        dot = next((d for d in _DOT_BEFORE if text.endswith(d, free, start)), None) if start < at else None
        if dot is None or start - len(dot) <= free or text[start - len(dot) - 1] not in _LOCAL:
            return edits[::-1]
        at = start - len(dot)
        edits.append((at, start, "."))


def bare(text: str) -> tuple[str, Alignment | None]:
    """Bare words, as in 'first dot last at host dot com', on both sides of an at in any form, and dots between figures."""
    edits: list[tuple[int, int, str]] = []
    for m in _BARE.finditer(text):
        free = edits[-1][1] if edits else 0
        if m.start() < free:
            continue
        if m["dot"]:
            edits.append((*m.span(), "."))
            continue
        edits += _dots_before(text, m.start(), free)
        if m[0] != "@":
            edits.append((*m.span(), "@"))
        if _BARE_HOST.match(text, m.end()):
            domain = _BARE_DOMAIN.match(text, m.end())
            edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, m.end(), domain.end())]
    return rewrite(text, edits) if edits else (text, None)


TRANSDUCERS = (homoglyphs, spelled_digits, bracketed, bare)


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Spans by kind: those of the plain text, and all."""
    text = text or ""
    base = {kind: detect(text) for kind, detect in DETECTORS.items()}
    plain, aligned = text, []
    for transduce in TRANSDUCERS:
        plain, alignment = transduce(plain)
        if alignment is not None:
            aligned.append(alignment)
    if not aligned:
        return base, base
    spans = {}
    for kind, detect in DETECTORS.items():
        spans[kind] = list(base[kind])
        for start, end in detect(plain):
            was = plain[start:end]
            for alignment in reversed(aligned):
                start, end = alignment.back(start, end)
            near = bisect.bisect_right(base[kind], start, key=lambda span: span[0]) - 1
            if text[start:end] != was and not (near >= 0 and end <= base[kind][near][1]):
                spans[kind].append((start, end))
        spans[kind].sort()
    return base, spans


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind; spans that overlap go together, as the kind of the first and longest."""
    if not text:
        return text
    edits: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(((s, e, k) for k, found in find(text)[1].items() for s, e in found), key=lambda x: (x[0], -x[1])):
        if not edits or start >= edits[-1][1]:
            edits.append((start, end, PLACEHOLDER[kind]))
        elif end > edits[-1][1]:
            edits[-1] = (edits[-1][0], end, edits[-1][2])
    return rewrite(text, edits)[0] if edits else text


DETECTED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _detected(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans = find(text)
        rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(map(len, spans.values())) - sum(map(len, base.values()))))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


def redact(text: str) -> F.Column:
    return F.pandas_udf(_redacted, "string")(F.col(text))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by kind in the plain text, their digest, all spans, and how many the transducers added."""
    return docs.select(F.col(id_col), F.pandas_udf(_detected, DETECTED)(F.col(text_col)).alias("found")).select(id_col, "found.*")
