"""Script and orthography measures as Column expressions.

All of them take a string Column and give null for a null input unless said otherwise; an empty text has no tokens and rates of 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's str.isspace sees it, as a Java regex class.
WS = r"(?U:[\s\x1c-\x1f])"
NOT_WS = r"(?U:[^\s\x1c-\x1f])"


@dataclass(frozen=True)
class ScriptProfile:
    """What the measures need to know about a script. All regexes are character classes (without brackets)."""

    block: str
    #: Signs that can't begin a word.
    dependent: str
    #: Letters whose threefold repetition is suspect.
    letters: str
    #: Signs that can't follow white space.
    orphans: str
    terminators: str


#: Fixed values of the Bengali script: its block, dependent signs (U+09BE-09C4, 09C7, 09C8, 09CB, 09CC, 09D7, 09BC, 09CD), letters, sentence ends.
BENGALI = ScriptProfile(
    block=r"\x{0980}-\x{09FF}",
    dependent=r"\x{09BC}\x{09BE}-\x{09C4}\x{09C7}\x{09C8}\x{09CB}\x{09CC}\x{09CD}\x{09D7}",
    letters=r"\x{0985}-\x{09B9}",
    orphans=r"\x{09BE}-\x{09CC}\x{09CD}",
    terminators=r"\x{0964}\x{09E4}\x{09E5}?!",
)
#: Names of fonts made for an older, incompatible encoding. Fixed pattern.
LEGACY_FONT = r"(?i)(MJ\b|SutonnyMJ|Bijoy|Boishakhi)"
#: Rate of tokens with an illegal first sign above which a text is corrupt; rate of Latin words above which a page is suspect.
CORRUPT_RATE, LATIN_RATE = 0.005, 0.10


def trim_ws(text: Column) -> Column:
    """The text without white space (in Python's sense) at its ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, f"{WS}+", " "))


def nfc(text: Column) -> Column:
    """Canonical composition (NFC). Spark has no builtin for it: one Arrow batch function."""

    @F.pandas_udf("string")
    def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.str.normalize("NFC")

    return compose(text)


def visible_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_WS))


def script_ratio(text: Column, script: ScriptProfile = BENGALI) -> Column:
    """Characters of the script's block among those that aren't white space; 0 when there are none."""
    visible = visible_chars(text)
    return F.when(visible > 0, F.regexp_count(text, F.lit(f"[{script.block}]")) / visible).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def script_tokens(text: Column, script: ScriptProfile = BENGALI) -> Column:
    """White-space separated tokens that hold a character of the script."""
    return F.filter(F.split(text, f"{WS}+"), lambda t: t.rlike(f"[{script.block}]"))


def starts_dependent(token: Column, script: ScriptProfile = BENGALI) -> Column:
    return token.rlike(f"^[{script.dependent}]")


def triple_runs(text: Column, script: ScriptProfile = BENGALI) -> Column:
    return F.regexp_count(text, F.lit(rf"([{script.letters}])\1\1"))


def orphaned_signs(text: Column, script: ScriptProfile = BENGALI) -> Column:
    return F.regexp_count(text, F.lit(f"{WS}[{script.orphans}]"))


def orthography(text: Column, script: ScriptProfile = BENGALI) -> Column:
    """struct(tokens, initial_dependent, rate, samples, triples, orphaned); samples are the first eight offending tokens."""
    tokens = script_tokens(text, script)
    bad = F.filter(tokens, lambda t: starts_dependent(t, script))
    return F.struct(
        F.size(tokens).cast("long").alias("tokens"),
        F.size(bad).cast("long").alias("initial_dependent"),
        (F.size(bad) / F.greatest(F.size(tokens), F.lit(1))).alias("rate"),
        F.slice(bad, 1, 8).alias("samples"),
        triple_runs(text, script).cast("long").alias("triples"),
        orphaned_signs(text, script).cast("long").alias("orphaned"),
    )


def looks_corrupt(rate: Column, triples: Column, threshold: float = CORRUPT_RATE) -> Column:
    return (rate > threshold) | (triples > 0)


def latin_intrusion(text: Column, script: ScriptProfile = BENGALI) -> Column:
    """struct(latin, total, rate, samples): Latin words of two letters or more against the script's tokens."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))
    latin = F.size(words)
    total = latin + F.size(script_tokens(text, script))
    return F.struct(
        latin.cast("long").alias("latin"),
        total.cast("long").alias("total"),
        F.when(total > 0, latin / total).otherwise(F.lit(0.0)).alias("rate"),
        F.slice(words, 1, 8).alias("samples"),
    )


def font_key(name: Column) -> Column:
    """A font's name without its subset prefix (up to the first plus sign), at most 24 characters; empty for null."""
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[^+]*\+", ""), 1, 24)


def legacy_font(name: Column) -> Column:
    return name.rlike(LEGACY_FONT)


def suspect_font(name: Column, definition: Column) -> Column:
    """A font without a map to Unicode, or of a legacy encoding."""
    return ~F.coalesce(definition, F.lit("")).contains("/ToUnicode") | F.coalesce(legacy_font(name), F.lit(False))


def font_encoding(definition: Column) -> Column:
    return F.when(definition.contains("WinAnsiEncoding"), "WinAnsiEncoding").when(definition.contains("Identity-H"), "Identity-H").otherwise("other")


def triage(raw: Column, fonts_ok: Column, least_chars: int = 20, script: ScriptProfile = BENGALI) -> Column:
    """Where a page's text is to come from: ``empty`` below 20 visible-trimmed characters, ``textlayer`` when fonts and spelling are sound, else ``needs_ocr``."""
    o = orthography(raw, script)
    chars = F.length(trim_ws(F.coalesce(raw, F.lit(""))))
    return (
        F.when(chars < least_chars, "empty")
        .when(F.coalesce(fonts_ok, F.lit(True)) & ~looks_corrupt(o["rate"], o["triples"]), "textlayer")
        .otherwise("needs_ocr")
    )
