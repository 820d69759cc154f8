"""Problem 5: text that was decoded with the wrong character encoding.

The garbled form of every character of interest is computed for every pair (right encoding, wrong encoding);
all forms go into one multi-pattern automaton. Only matched spans are replaced, so correct text beside a garbled
span stays untouched. The search is repeated on its own result until it finds nothing, which undoes text garbled several times.

Letters of any other script are found by whole runs: a run of characters that some wrong encoding gives to high bytes, whose bytes are UTF-8 from end to end, is one
span. A run that is so only in part is told as lost and left as it is, so that text of a script the automaton doesn't list isn't damaged further.

Losses are spans too: a lead pair of an Indic letter whose last byte was dropped, and U+FFFD. They are found but have no
certain original; ``restore(text, guess=True)`` puts a likely letter there for operators that only need statistics.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes are often read with by mistake.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "iso8859_15", "cp1254", "koi8_r", "iso8859_5", "iso8859_2")
#: Encodings that bytes of Windows-1252 are often read with by mistake (one byte a character).
WRONG_FOR_1252 = ("cp1251", "koi8_r", "iso8859_5")
#: Characters of a run that is decoded as a whole, at least.
RUN = 4

_INDIC = [(0x0900, 0x0980), (0x0980, 0x0A00)]
_LATIN = "".join(chr(c) for c in range(0xA0, 0x180))
_MARKS = "‐‑‒–—―‘’‚“”„†‡•…‰‹›€™−×÷≤≥≠∞■●○​‌‍﻿  "
_LEADS = {b"\xe0\xa4": "D", b"\xe0\xa5": "d", b"\xe0\xa6": "B", b"\xe0\xa7": "b"}


def _decode(raw: bytes, encoding: str, undefined: str) -> str:
    """Decode byte by byte; what the encoding leaves undefined becomes the C1 control, nothing or U+FFFD."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append({"keep": chr(b), "drop": "", "mark": "�"}[undefined])
    return "".join(out)


@lru_cache(maxsize=1)
def _tables() -> tuple:
    """(automaton, first characters of its patterns). A pattern's value is (replacement or None, loss class)."""
    import ahocorasick

    forms: dict[str, tuple[str | None, str]] = {}
    # what a first wrong reading yields can be garbled again, so the upper halves of all encodings count as letters
    upper = {_decode(bytes([b]), encoding, "keep") for encoding in WRONG_FOR_UTF8 for b in range(0x80, 0x100)}
    letters = [chr(c) for lo, hi in _INDIC for c in range(lo, hi)] + sorted(upper.union(_LATIN, _MARKS))
    for encoding in WRONG_FOR_UTF8:
        for ch in letters:
            raw = ch.encode()
            garbled = _decode(raw, encoding, "keep")
            if garbled != ch and len(garbled) > 1:
                forms.setdefault(garbled, (ch, ""))
        for lead, kind in _LEADS.items():
            forms.setdefault(_decode(lead, encoding, "keep"), (None, kind))
            forms.setdefault(_decode(lead, encoding, "keep") + "�", (None, kind))
    automaton = ahocorasick.Automaton()
    for form, value in forms.items():
        automaton.add_word(form, (len(form), value))
    automaton.make_automaton()
    return automaton, "".join(sorted({f[0] for f in forms}))


@lru_cache(maxsize=1)
def _high() -> dict[str, dict[str, int]]:
    """Wrong encoding -> character -> the high byte that it stands for."""
    return {e: {_decode(bytes([b]), e, "keep"): b for b in range(0x80, 0x100)} for e in WRONG_FOR_UTF8}


#: Areas of Unicode that hold all characters which the wrong encodings give to high bytes.
_HIGH_AREAS = "[\\u0080-\\u058f\\u2000-\\u26ff\\uf8ff-\\ufb0f]"


def _class(chars) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(chars)) + "]"


def trigger() -> str:
    """A regex (for Java and Python alike) that every affected text matches."""
    return "[" + _class(set(_tables()[1]))[1:-1] + "\\ufffd\\u0400-\\u045f]|" + _HIGH_AREAS + f"{{{RUN}}}"


@lru_cache(maxsize=1)
def _trigger() -> re.Pattern:
    return re.compile(trigger())


@lru_cache(maxsize=1)
def _runs() -> re.Pattern:
    return re.compile(_class({c for table in _high().values() for c in table}) + f"{{{RUN},}}")


@lru_cache(maxsize=1)
def _listed() -> frozenset[str]:
    """Characters whose garbled forms the automaton has."""
    return frozenset(original for _, (original, _) in _tables()[0].values() if original)


def _foreign(ch: str) -> bool:
    """A letter or sign of a script that the automaton doesn't list."""
    return ch not in _listed() and ord(ch) > 0x17F and unicodedata.category(ch)[0] in "LM"


def _whole_runs(text: str, known: list[tuple[int, int, str | None, str]]) -> list[tuple[int, int, str | None, str]]:
    """Spans of text of other scripts: runs that the ``known`` spans don't cover wholly, and whose bytes are UTF-8 (or were, before some were lost) under one of the wrong encodings."""
    spans: list[tuple[int, int, str | None, str]] = []
    covered = bytearray(len(text))
    for a, b, *_ in known:
        covered[a:b] = b"\1" * (b - a)
    for m in _runs().finditer(text):
        if 0 not in covered[m.start() : m.end()]:
            continue
        best: tuple[int, str | None] = (0, None)
        for table in _high().values():
            if any(c not in table for c in m[0]):
                continue
            raw = bytes(table[c] for c in m[0])
            shown = raw.decode("utf-8", "replace")
            letters = sum(map(_foreign, shown))
            if "\ufffd" not in shown and letters >= 1 and all(c in _listed() or _foreign(c) or unicodedata.category(c)[0] in "NPZ" for c in shown):
                best = (len(raw), shown)
                break
            if letters >= 2 and letters > shown.count("\ufffd") and letters > best[0]:
                best = (letters, None)
        if best[0]:
            spans.append((m.start(), m.end(), best[1], "?" if best[1] is None else ""))
    return spans


_CYRILLIC_RUN = re.compile("[Ѐ-џ]+")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ɏ]")


@lru_cache(maxsize=1)
def _single() -> dict[str, str]:
    """Cyrillic letter -> the Western letter or sign that has its byte in Windows-1252."""
    out: dict[str, str] = {}
    for encoding in WRONG_FOR_1252:
        for b in range(0xA0, 0x100):
            out.setdefault(bytes([b]).decode(encoding, "replace"), bytes([b]).decode("cp1252"))
    return out


def _single_spans(text: str) -> list[tuple[int, int, str | None, str]]:
    """Cyrillic letters strewn into Latin text: one or two in a row, beside a Latin letter, or anywhere in a text without a Cyrillic word."""
    runs = list(_CYRILLIC_RUN.finditer(text))
    strewn = [m for m in runs if len(m[0]) <= 2]
    if len(strewn) < len(runs):
        strewn = [m for m in strewn if _LATIN_LETTER.match(text, m.end()) or (m.start() and _LATIN_LETTER.match(text, m.start() - 1))]
    table = _single()
    return [(m.start(), m.end(), "".join(table.get(c, c) for c in m[0]), "") for m in strewn]


def find_spans(text: str) -> list[tuple[int, int, str | None, str]]:
    """(start, end, original or None, loss class) of each garbled span, in order, longest match first."""
    if not text or not _trigger().search(text):
        return []
    spans = [(end + 1 - n, end + 1, original, kind) for end, (n, (original, kind)) in _tables()[0].iter_long(text)]
    if whole := _whole_runs(text, spans):
        covered = [False] * (len(text) + 1)
        for a, b, *_ in whole:
            covered[a:b] = [True] * (b - a)
        spans = sorted([x for x in spans if not covered[x[0]] and not covered[x[1] - 1]] + whole, key=lambda x: x[:2])
    if not spans:
        spans = _single_spans(text)
    if "�" in text:
        taken = {i for a, b, *_ in spans for i in range(a, b)}
        spans = sorted(spans + [(m.start(), m.end(), None, "?") for m in re.finditer("�+", text) if m.start() not in taken], key=lambda x: x[:2])
    return spans


def _is_consonant(ch: str) -> bool:
    return bool(ch) and (0x0915 <= ord(ch) <= 0x0939 or 0x0995 <= ord(ch) <= 0x09B9 or ch in "ৰৱড়ঢ়য়")


def _restore(chars: list[str], raw: list[str], write, guess: bool) -> tuple[list[str], int, bool]:
    """Puts right the garbled spans of a text given as its characters and, for each, how it is written (``raw``); ``write`` says how a new character is.
    Gives the written text, the number of spans of the first layer, and whether something is lost."""
    count, lost, layer = 0, False, 0
    while spans := find_spans(text := "".join(chars)):
        if layer == 0:
            count = len(spans)
        layer += 1
        lost = any(o is None for _, _, o, _ in spans)
        new_chars, new_raw, at = [], [], 0
        for i, (a, b, original, kind) in enumerate(spans):
            new_chars += chars[at:a]
            new_raw += raw[at:a]
            if original is None and guess:
                following = spans[i + 1][2] or "" if i + 1 < len(spans) and spans[i + 1][0] == b else ""
                original = _guess(kind, following, bool(a and text[a - 1].strip() == "" and not (i and spans[i - 1][1] == a)))
            if original is None:
                new_chars += chars[a:b]
                new_raw += raw[a:b]
            else:
                new_chars += original
                new_raw += map(write, original)
            at = b
        new_chars += chars[at:]
        new_raw += raw[at:]
        if new_chars == chars or not any(o is not None for _, _, o, _ in spans):
            chars, raw = new_chars, new_raw
            break
        chars, raw = new_chars, new_raw
    return raw, count, lost


def restore(text: str, guess: bool = False) -> tuple[str, int, bool]:
    """(text with its garbled spans put right, number of spans of the first layer, whether something is lost).

    Null and empty texts come back as they are with no span. Lost spans stay as they are unless ``guess``. A text garbled several times over is undone layer by layer
    until nothing garbled is found; each layer is shorter or has fewer foreign letters than the one before, so this ends.
    """
    if not text or not _trigger().search(text):
        return text, 0, False
    raw, count, lost = _restore(list(text), list(text), str, guess)
    return "".join(raw), count, lost


_ESCAPE = re.compile(r'\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.', re.S)
_SHORT = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\b": "\b", "\\f": "\f"}


def restore_json(value: str) -> tuple[str, int, bool]:
    """``restore`` for a JSON text, whole or cut off: characters behind escapes are searched too, and everything outside the spans stays as it is written."""
    if "\\u" not in value:
        return restore(value)
    raw = _ESCAPE.findall(value)
    chars = [x if len(x) == 1 else _unescape(x) for x in raw]
    fixed, count, lost = _restore(chars, raw, lambda c: json.dumps(c, ensure_ascii=False)[1:-1], False)
    return "".join(fixed), count, lost


def _unescape(written: str) -> str:
    """The one character that an escape stands for; a lone surrogate as U+0000."""
    if len(written) == 2:
        return _SHORT.get(written, written[-1])
    units = [int(x, 16) for x in written.split("\\u")[1:]]
    code = 0x10000 + ((units[0] - 0xD800) << 10) + units[1] - 0xDC00 if len(units) == 2 else units[0]
    return "\0" if 0xD800 <= code < 0xE000 else chr(code)


def _guess(kind: str, following: str, word_start: bool) -> str:
    """The likeliest letter for a lead pair without its last byte: among the five bytes that Windows-1252 leaves undefined."""
    if kind == "B":
        return "এ"
    if kind == "D":
        return "ए" if word_start else "ँ"
    if kind == "b":
        return "্" if _is_consonant(following) else "ু"
    if kind == "d":
        return "्" if _is_consonant(following) else "ु"
    return ""


def clean(text: str | None) -> str:
    """The text as statistics should see it: repaired, lost spans guessed, null as empty."""
    if not text:
        return ""
    if not _trigger().search(text):
        return text
    return restore(text, guess=True)[0]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, page, field, value in zip(pdf["document_id"], pdf["page_no"], pdf["field"], pdf["value"]):
            fixed, spans, lost = restore_json(value) if field == "quality" else restore(value)
            if spans:
                out.append((doc, page, field, spans, not lost, fixed))
        yield pd.DataFrame(out, columns=["document_id", "page_no", "field", "n_spans", "repairable", "repaired"]).astype({"page_no": "Int32", "n_spans": "int64"})


def repair_encoding(pages: DataFrame) -> DataFrame:
    """One row per page and field (``raw_text``, ``quality``) that holds garbled text.

    Columns: document_id, page_no, field, n_spans (garbled spans), repairable (nothing is lost), repaired (the field with
    every span of known origin put right). Null and empty fields have no row; a row delivered twice counts once (deliveries
    of a page with different content each have a row); other columns of the input are ignored.

    Only texts with a character that some garbled form begins with go to Python; the test for it is a pushed-down
    regex. The one shuffle, for repeated deliveries, moves affected rows alone.
    """
    both = pages.select(
        "document_id",
        "page_no",
        F.explode(F.array(
            F.struct(F.lit("raw_text").alias("field"), F.col("raw_text").alias("value")),
            F.struct(F.lit("quality").alias("field"), F.col("quality").alias("value")),
        )).alias("x"),
    ).select("document_id", "page_no", "x.field", "x.value")
    # \\u escapes of JSON hide the characters
    touched = both.filter(F.col("value").rlike(trigger()) | ((F.col("field") == "quality") & F.col("value").contains("\\u")))
    found = touched.mapInPandas(_rows, "document_id string, page_no int, field string, n_spans long, repairable boolean, repaired string")
    return found.dropDuplicates()
