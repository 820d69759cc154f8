"""Tokens, overlap and edit distances as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def claim_tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or characters of the Bengali block, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\x{0980}-\x{09FF}]{2,}"), F.lit(0))


def overlap(claim: Column, span: Column) -> Column:
    """Share of the claim's tokens (repeats count) that the span holds; 0 when the claim has none. Both are tokenized once, outside the loop over the claim's tokens."""
    both = F.array(F.struct(claim_tokens(claim).alias("c"), F.array_distinct(claim_tokens(span)).alias("s")))

    def share(x: Column) -> Column:
        return F.when(F.size(x["c"]) > 0, F.size(F.filter(x["c"], lambda t: F.array_contains(x["s"], t))) / F.size(x["c"])).otherwise(F.lit(0.0))

    return F.transform(both, share)[0]


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and substitutions between two sequences (characters of a string, or words), however long.

    Bit-parallel: a column of the table of distances is kept as the bits of two integers, so each element of ``b`` takes a few operations on integers of len(a) bits.
    """
    most = min(len(a), len(b))
    lead = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - lead) if a[-1 - i] != b[-1 - i]), most - lead)
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)  # rows where the column rises or falls by one
    for x in b:
        same = where.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (every & ~(across | up)), up & across
        distance += bool(rises & last) - bool(falls & last)
        rises, same = (rises << 1) | 1, same | down
        up, down = ((falls << 1) | ~(same | rises)) & every, rises & same & every
    return distance


def normalized(text: str | None) -> str:
    """NFC with white space collapsed; null as empty."""
    return " ".join(unicodedata.normalize("NFC", text).split()) if text else ""


def _rates(reference: str | None, hypothesis: str | None) -> tuple[float | None, float | None]:
    r, h = normalized(reference), normalized(hypothesis)
    if not r:
        return None, None
    words = r.split(" ")
    return edit_distance(r, h) / len(r), edit_distance(words, h.split(" ") if h else []) / len(words)


def error_rates(reference: Column, hypothesis: Column) -> Column:
    """struct(cer, wer): edits by the length of the reference, in characters and in words, over texts in NFC with white space collapsed; null for an empty reference; may exceed 1.

    One Arrow batch function: the builtin distance fills a whole table of cells, this one is bit-parallel and normalises each text once.
    """

    @F.pandas_udf("cer double, wer double")
    def both(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rates(x, y) for x, y in zip(r, h)], columns=["cer", "wer"], dtype="float64")

    return both(reference, hypothesis)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; see ``error_rates``."""
    return error_rates(reference, hypothesis)["cer"]


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate; see ``error_rates``."""
    return error_rates(reference, hypothesis)["wer"]


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length over texts in NFC with white space collapsed; 1 for two empty texts, null as empty."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = ((normalized(p), normalized(q)) for p, q in zip(x, y))
        return pd.Series([1 - edit_distance(p, q) / max(len(p), len(q), 1) for p, q in pairs], dtype="float64")

    return alike(a, b)
