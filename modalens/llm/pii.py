"""Personal data with offset-preserving deobfuscation.

Two passes over every whole text. The plain pass finds e-mail, IP, card and phone spans in the text as it stands. The
second pass runs a chain of transducers that write a normalised copy: homoglyphs and full-width forms to ASCII, spelled
digits next to each other or to literal ones to digits, "plus" and at/dot disguises to their signs ("at" before any host
whose ending is a top-level domain, so "us at example.com" counts as an address too). Each transducer is a list of edits (start, end,
replacement) over its input, so an offset in its output maps back to the source characters it came from. The same
detectors then run over the normalised copy, and a span that does not lie inside a known one of its kind is mapped back
and added; redaction takes the union of all spans.

Offsets count code points, ends are exclusive. Defined cases: a null text is empty and has no span; repeated rows give
repeated rows; a null doc_id stays null; an empty table gives no rows; other columns are ignored. Every pass is linear
in the text (but for sorting its spans), however long its runs of digits or letters are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import whole_text
from modalens.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
#: Characters of an e-mail's local part, and the four patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only begin where a run of digits does, so the look-behind keeps long runs linear and changes no match.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like ASCII ones, by alphabet.
HOMOGLYPHS = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһ", "ABESIJKMHOPCTYXaeijopcyxsdqwh"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυ", "ABEZHIKMNOPTYXoavikpu"),
    "Armenian": ("ՍՏՕԼհոսցօյքզ", "USOLhnugojpq"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "AbCDEGHiJKLMPRSTVWZ"),
    "Coptic": ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "ABEHIKMNOPCTXopc"),
    "Latin": ("ıɑɡᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "iagabcdeghijklmnoprstuvwyz"),
    "signs": ("․。．﹒＠﹫＋‐‑‒–—−", "....@@+------"),
}
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}

#: Words that stand before "dot" in plain prose; after them only the usual endings make a host, as "at the dot is" does not.
DETERMINERS = frozenset(("a", "an", "each", "every", "that", "the", "this"))
USUAL = frozenset("com org net edu gov mil info biz io dev app co ai de fr es it nl be ch eu uk us ca au jp cn ru in br pl se no".split())

_TO_ASCII = {ord(a): b for one, other in HOMOGLYPHS.values() for a, b in zip(one, other, strict=True)}
#: Blocks of enclosed capital letters that no normal form maps to plain ones.
_TO_ASCII |= {first + i: chr(65 + i) for first in (0x1F150, 0x1F170, 0x1F1E6) for i in range(26)}
#: By rule: decimal digits of every script, and what compatibility normalisation makes one ASCII character
#: (full-width, mathematical, circled, super- and subscript forms).
for _c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x1E000), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA))):
    _plain = str(unicodedata.decimal(_c)) if unicodedata.decimal(_c, None) is not None else unicodedata.normalize("NFKC", _c)
    if len(_plain) == 1 and _plain.isascii():
        _TO_ASCII.setdefault(ord(_c), _plain)
_ODD = frozenset(map(chr, _TO_ASCII))  # a pattern of this many characters beyond the basic plane is searched one by one
_INVISIBLE = re.compile("[​-‍⁠﻿­]+")
#: A first letter as a plain set lets the search skip to it; what stands before it and the rest are judged there.
_FIRST = "".join(sorted({c for w in SPELLED for c in (w[0].lower(), w[0].upper())}))
_SPELLED = re.compile(f"[{_FIRST}](?<![A-Za-z0-9].)(?i:" + "|".join(f"(?<={w[0]}){w[1:]}" for w in SPELLED) + ")(?![A-Za-z0-9])")
_GAP = r"(?:[ ().-]|[ -]{2}| \(|\) )"
_AFTER_DIGIT = re.compile(rf"[0-9+]{_GAP}$")
_BEFORE_DIGIT = re.compile(rf"{_GAP}(?=[0-9])")
_BETWEEN = re.compile(rf"{_GAP}$")
_BRACKETED = re.compile(r" {0,2}[\[({<] {0,2}(at|dot|@|\.) {0,2}[\])}>] {0,2}", re.I)
_WORDS = re.compile(r"(?<=[A-Za-z0-9]) at (?=((?:[A-Za-z0-9-]{1,63}(?: dot |\.)){1,24}[A-Za-z0-9-]{1,63}))", re.I)
_LABEL = re.compile(r" dot |\.", re.I)
_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)
_HINT = re.compile(r"[\[({<] {0,2}(?:at|dot|@|\.) {0,2}[\])}>]| dot | at ", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def detect(text: str) -> set[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans; per kind leftmost and non-overlapping, failing ones dropped."""
    spans = {(a, 0, b) for a, b in emails(text)} if "@" in text else set()
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.add((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.add((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                spans.add((m.start(), 3, m.end()))
    return spans


class Normalised:
    """A text and its way back: runs of output, each with where its source begins and whether it was copied."""

    def __init__(self, text: str):
        self.text, self.back = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """One transducer: edits (start, end, replacement) of the present text, in order and apart from each other."""
        if not edits:
            return
        parts, runs, at, out = [], [], 0, 0
        for a, b, new in edits:
            for piece, source, copied in ((self.text[at:a], at, True), (new, a, False)):
                if piece:
                    runs.append((out, source, len(piece) if copied else b - a, copied))
                    parts.append(piece)
                    out += len(piece)
            at = b
        if at < len(self.text):
            runs.append((out, at, len(self.text) - at, True))
            parts.append(self.text[at:])
        self.text = "".join(parts)
        self.back.append((runs, [r[0] for r in runs]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that text[start:end] came from."""
        last = end - 1
        for runs, starts in reversed(self.back):
            o, s, n, copied = runs[bisect_right(starts, start) - 1]
            start = s + (start - o if copied else 0)
            o, s, n, copied = runs[bisect_right(starts, last) - 1]
            last = s + (last - o if copied else n - 1)
        return start, last + 1


def is_host(said: str) -> bool:
    """Whether labels with dots or spelled dots between them have a top-level domain after the first one."""
    labels = _LABEL.split(said.lower())
    return any(x in USUAL or x in ENDINGS and before not in DETERMINERS for before, x in zip(labels, labels[1:], strict=False))


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits of the spelled digits and signs that stand next to another one or to a literal digit or sign."""
    words, edits = list(_SPELLED.finditer(text)), []
    for i, m in enumerate(words):
        a, b, sign = m.start(), m.end(), SPELLED[m[0].lower()]
        ahead = words[i + 1].start() if i + 1 < len(words) and _BETWEEN.match(text[b : min(words[i + 1].start(), b + 3)]) else 0
        if not ahead and (digit := _BEFORE_DIGIT.match(text, b)):
            ahead = digit.end()
        behind = i and _BETWEEN.match(text[words[i - 1].end() : a][:3]) or _AFTER_DIGIT.search(text[max(0, a - 3) : a])
        if ahead or behind:
            edits.append((a, ahead if ahead and sign == "+" else b, sign))
    return edits


def normalise(text: str) -> Normalised | None:
    """The deobfuscated copy, or None where no transducer has anything to do."""
    n = Normalised(text)
    if not text.isascii():
        n.rewrite([(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)])
        if not _ODD.isdisjoint(n.text):
            n.text = n.text.translate(_TO_ASCII)  # one character for one: offsets stay
    if _HINT.search(n.text):
        n.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(n.text)])
        n.rewrite([(m.start(), m.end(), "@") for m in _WORDS.finditer(n.text) if is_host(m[1])])
        n.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(n.text)])
    n.rewrite(spelled(n.text))
    return n if n.back or n.text != text else None


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans and all spans, as (start, kind's number, end) in order."""
    base = detect(text)
    found = set(base)
    if n := normalise(text):
        ends, plain, at = [-1] * len(KINDS), sorted(base), 0  # furthest end of each kind's spans that begin no later
        for a, kind, b in sorted((a, kind, b) for start, kind, end in detect(n.text) for a, b in (n.source(start, end),)):
            while at < len(plain) and plain[at][0] <= a:
                ends[plain[at][1]] = max(ends[plain[at][1]], plain[at][2])
                at += 1
            if b > ends[kind]:
                found.add((a, kind, b))
                ends[kind] = b
    return sorted(base), sorted(found)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of spans replaced by the kind of its first one in angle brackets."""
    parts, at, open_end = [], 0, -1
    for a, k, b in spans:
        if a >= open_end:
            parts += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = open_end = max(open_end, b)
    return "".join([*parts, text[at:]])


_OUT = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string, clean string"


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the plain spans by kind, n_added, base and spans as text, the clean text."""

    @F.pandas_udf(_OUT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, found = find(t)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(4)), len(found) - len(base), said(base), said(found), redacted(t, found) if found else t))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col(id_col), scan(whole_text(text_col)).alias("p")).select(id_col, "p.*")


def redacted_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the clean text in place of the text; a null text stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else redacted(t, find(t)[1]) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the query returns: the counts, the digest of the plain spans and all spans; no text leaves the tasks."""
    counts = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{c} long" for c in (*counts, "n_added")) + ", base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, found = find(t)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(4)), len(found) - len(base), sha256(said(base).encode()).hexdigest(), said(found)))
            yield pd.DataFrame(rows, columns=[*counts, "n_added", "base_sha256", "spans"])

    return docs.select(F.col(id_col), scan(whole_text(text_col)).alias("p")).select(id_col, "p.*")
