"""Offset-preserving normalisation of text: what is written in a disguise is
spelled plainly, and every span of the plain text leads back to its source."""

from __future__ import annotations

import re
from bisect import bisect_right

# Look-alike letters of other scripts and their Latin shapes.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "ABEKMHOPCTXaeopcyxijsABEZHIKMNOPTYXo",
    )
)
# Hyphens, spaces and invisible characters.
HYPHENS = "‐‑‒–−－ー"
SPACES = "             　"
INVISIBLE = "­​‌‍⁠﻿"
# Digits spelled in words, as used in numbers read aloud.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ONE = {**{c: "-" for c in HYPHENS}, **{c: " " for c in SPACES}, **{c: "" for c in INVISIBLE}, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}}
# full-width punctuation that separates sentences and labels stays as it is
for _c in "：，；、！？":
    _ONE.pop(_c, None)
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = re.compile(rf"\b(?:{_DIGIT})(?:[ -](?:{_DIGIT})){{5,}}\b", re.I)
_WORD = re.compile(_DIGIT, re.I)
_SPELLED_MARKS = tuple(f" {word}" for word in SPELLED)
_PLAIN = "".join(_ONE)
#: Disguises by kind; a kind is searched for only in texts that hold its mark.
_SIGNS = re.compile(rf"[@＠{_PLAIN}](?:(?<=[@＠])(?: (?=\S)|\n(?=\S))?|(?<=[{_PLAIN}])[{_PLAIN}]*)")
_BROKEN = re.compile(r"[-‐‑－][\u200b\u00ad]?\n(?=[^\W\d_])")
_WRITTEN = re.compile(r"[\[({<](?:(?:at|AT|At|arroba|ARROBA|arobase|AROBASE)|(?:dot|DOT|Dot|punkt|PUNKT|punto|PUNTO|point|POINT))[\])}>] ?")
# Ends of domain names; a bare at and dot is a disguise only before one of them.
ENDINGS = "com org net edu gov info biz eu io de at ch fr be es it nl pl pt uk ie us ca mx br ar cn jp kr tw in au nz se no dk fi ru".split()
_BARE = re.compile(rf"(?<=[A-Za-z0-9])( +at +)(?=(?:[A-Za-z0-9-]+(?:\.| +dot +))+(?:{'|'.join(ENDINGS)})\b)(?:[A-Za-z0-9-]+(?:\.| +dot +))*?[A-Za-z0-9-]+ +dot +(?:[A-Za-z0-9-]+(?:\.| +dot +))*(?:{'|'.join(ENDINGS)})\b", re.I)
_BARE_DOT = re.compile(r" +dot +", re.I)
_ENTITY = re.compile(r"&(?:#64;|#x40;|commat;|nbsp;)")
_BROKEN_MARKS = ("-\n", "-\u200b\n", "-\u00ad\n", "‐\n", "‑\n", "－\n")
_HOMOGLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}]")
_MIXED = re.compile(r"[A-Za-z]")
_LETTERS = re.compile(r"[^\W\d_]+")


class Plain:
    """The plain form of a text, with the way back to its characters."""

    def __init__(self, source: str):
        edits: list[tuple[int, int, str]] = []
        found = list(_SIGNS.finditer(source)) if not source.isascii() or "@" in source else []
        if "&" in source:
            found += _ENTITY.finditer(source)
        found += _WRITTEN.finditer(source)
        if any(mark in source for mark in _BROKEN_MARKS):
            found += (m for m in _BROKEN.finditer(source) if source[m.start() - 1 : m.start()].isalpha())
        lower = source.lower()
        if " dot " in lower and " at " in lower:
            for m in _BARE.finditer(source):
                edits.append((*m.span(1), "@"))
                edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(source, m.end(1), m.end())]
        for m in found:
            start, text = m.start(), m.group()
            if text[0] in "[({<@＠" and source[start - 1 : start] == " " and start > 1:
                start -= 1
            edits.append((start, m.end(), self._spelling(text)))
        if not source.isascii() and _HOMOGLYPH.search(source):  # Latin words with letters of other scripts
            for word in _LETTERS.finditer(source):
                if _HOMOGLYPH.search(word.group()) and _MIXED.search(word.group()):
                    edits += [(word.start() + i, word.start() + i + 1, HOMOGLYPHS[c]) for i, c in enumerate(word.group()) if c in HOMOGLYPHS]
        spaced = lower.replace("-", " ")
        spelled = sum(map(spaced.count, _SPELLED_MARKS)) >= 5  # a number has six words, five of them after a space or hyphen
        for m in _NUMBER.finditer(source) if spelled else ():
            edits += [(m.start() + w.start(), m.start() + w.end(), SPELLED[w.group().lower()]) for w in _WORD.finditer(m.group())]
        # where two begin together the longer one counts
        edits.sort(key=lambda e: (e[0], -e[1]))
        out, at, length = [], 0, 0
        #: of each edit: start and end in the plain text, start and end in the source
        self.plain_starts, self.plain_ends, self.source_starts, self.source_ends = [], [], [], []
        for start, end, new in edits:
            if start < at:
                continue
            out += [source[at:start], new]
            length += start - at
            self.plain_starts.append(length)
            length += len(new)
            self.plain_ends.append(length)
            self.source_starts.append(start)
            self.source_ends.append(end)
            at = end
        out.append(source[at:])
        self.source, self.text = source, "".join(out)

    @staticmethod
    def _spelling(found: str) -> str:
        core = found.strip()
        if core[:1] == "&":
            return " " if core == "&nbsp;" else "@"
        if core[:1] in "[({<" and len(core) > 1:
            return "@" if core[1:2] in "aA" else "."
        if "@" in found or "＠" in found:
            return "@"
        if found[-1] == "\n":
            return ""
        return "".join(_ONE[c] for c in found)

    def _back(self, at: int, end: bool) -> int:
        # the edit that starts last at or before the position
        i = bisect_right(self.plain_starts, at - end) - 1
        if i < 0:
            return at
        if at - end < self.plain_ends[i]:
            inside = at - self.plain_starts[i]
            if self.plain_ends[i] - self.plain_starts[i] == self.source_ends[i] - self.source_starts[i]:
                return self.source_starts[i] + inside
            return self.source_ends[i] if end else self.source_starts[i]
        return self.source_ends[i] + at - self.plain_ends[i]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a plain span that isn't empty."""
        return self._back(start, False), self._back(end, True)
