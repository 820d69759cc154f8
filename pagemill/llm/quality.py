"""Problem 2: text statistics of each page, and whether it is prose, a list, a table or junk.

The statistics come from one pass over each page's raw text, with garbled encodings put right beforehand. Weak labelling
rules name the clear cases; boosted trees are fitted on a bounded sample of those, their probabilities are calibrated on
the hand-checked holdout of ``quality_holdout``, and the trees then decide every page.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.encoding import clean
from pagemill.llm.gbt import BoostedTrees
from pagemill.llm.sampling import smallest_hashes
from pagemill.sources.shared import write_through

KINDS = ("prose", "list", "table", "junk")
#: At most so many pages (those with the smallest hash of their key) are read to fit the trees.
FIT_SAMPLE = 4000

FEATURES = (
    "n_words", "mean_word_len", "symbol_share", "end_punct_share", "common_share", "digit_share", "words_per_line", "max_words_line",
    "cell_share", "cells_per_line", "lead_share", "bullet_share", "pair_share", "vowel_share", "sign_share", "sign_start_share", "distinct_share",
    "one_letter_share", "long_word_share", "letter_share", "mid_stop_share", "even_cells",
)


class _Classes(dict):
    """Code point -> class: v Latin vowel, c other letter of an alphabet before the Indic blocks, i letter from there on, s sign, d digit, p punctuation, y symbol, space and newline as they are."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        cat = unicodedata.category(ch)
        if ch == "\n":
            out = "\n"
        elif ch.isspace() or cat in ("Cf", "Cc", "Zs"):
            out = " " if ch != "\t" else "t"
        elif cat == "Nd":
            out = "d"
        elif cat in ("Mn", "Mc"):
            out = "s"
        elif cat[0] == "L":
            out = ("v" if unicodedata.normalize("NFD", ch)[0].lower() in "aeiou" else "c") if code < 0x900 else "i"
        elif ch in ".,;:!?'\"()-–—‘’“”…।॥":
            out = "p"
        else:
            out = "y"
        self[code] = out
        return out


@lru_cache(maxsize=1)
def _classes() -> _Classes:
    return _Classes()


_EDGE = ".,;:!?।॥|\"'()[]{}“”‘’—–-‐•●*"
_CELL = re.compile(r"\t|\||;(?=\S)| {2,}(?=\S)")
_LEAD = re.compile(r"\.{4,}\s*\d*\s*$|(?:,\s*\d+)+\s*$")
_PAIR = re.compile(r"^[^:]{1,60}:\s\S")
_BULLET = re.compile(r"^\s*(?:[•●*–-]|\(?\d+[.)])\s")
_END = "।॥.?!"


def features(text: str, common: frozenset[str]) -> list[float]:
    """The statistics of one text, in the order of FEATURES. An empty text gives zeros."""
    text = clean(text)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    words = text.split()
    n, k = len(words), len(lines)
    if not n:
        return [0.0] * len(FEATURES)
    marks = text.translate(_classes())
    v, c, i, s, d, y = (marks.count(x) for x in "vcisdy")
    visible = len(marks) - marks.count(" ") - marks.count("\n") - marks.count("t")
    letters = v + c + i
    bare = [w.strip(_EDGE).lower() for w in words]
    per_line = [len(x.split()) for x in lines]
    cells = [len(_CELL.findall(x.strip("|"))) for x in lines]
    filled = [x for x in cells if x]
    starts = re.findall(r"(?<![^ \nt])s", marks)
    stops = sum(1 for w in words[:-1] if w[-1] in _END and not w[:-1].isdigit())
    top = max(set(filled), key=filled.count) if filled else 0
    return [
        float(n),
        sum(map(len, words)) / n,
        y / max(visible, 1),
        sum(x[-1] in _END for x in lines) / k,
        sum(w in common for w in bare) / n,
        d / max(visible, 1),
        n / k,
        float(max(per_line)),
        len(filled) / k,
        sum(cells) / k,
        sum(bool(_LEAD.search(x)) for x in lines) / k,
        sum(bool(_BULLET.match(x)) for x in lines) / k,
        sum(bool(_PAIR.match(x)) for x in lines) / k,
        v / (v + c) if v + c > 0.2 * letters and v + c else 0.4,
        s / i if i > 0.2 * letters and i else 0.5,
        len(starts) / n,
        len(set(bare)) / n,
        sum(len(w) == 1 and not w.isdigit() for w in bare) / n,
        sum(len(w) > 24 for w in words) / n,
        (letters + s) / max(visible, 1),
        stops / n,
        filled.count(top) / k if filled else 0.0,
    ]


def weak_label(row: dict[str, float]) -> int:
    """Class of a clear case by rules over the statistics, else -1."""
    r = row
    if r["n_words"] == 0:
        return 3
    tabular = r["cell_share"] > 0.6 and r["cells_per_line"] >= 1 and r["letter_share"] + r["digit_share"] > 0.55 and r["mid_stop_share"] < 0.03
    strange = (
        r["vowel_share"] < 0.24 or r["sign_share"] < 0.15 or r["sign_start_share"] > 0.15 or r["long_word_share"] > 0.5
        or r["one_letter_share"] > 0.3 or (r["distinct_share"] < 0.4 and r["n_words"] >= 15)
    )
    if r["common_share"] < 0.02 and not (r["cell_share"] > 0.6 and r["digit_share"] > 0.1 and r["letter_share"] > 0.2):
        if r["letter_share"] < 0.45 and (r["symbol_share"] > 0.1 or r["digit_share"] > 0.3) and r["lead_share"] < 0.5:
            return 3
        if strange and r["lead_share"] < 0.5 and r["bullet_share"] < 0.5 and r["pair_share"] < 0.5:
            return 3
    if tabular and r["common_share"] < 0.05:
        return 2
    short = r["words_per_line"] < 4.2 and r["end_punct_share"] < 0.1 and r["mid_stop_share"] < 0.03 and r["common_share"] < 0.05
    if (r["lead_share"] > 0.5 or r["pair_share"] > 0.5 or (r["bullet_share"] > 0.5 and r["words_per_line"] < 8)) and r["common_share"] < 0.05:
        return 1
    if short and not strange:
        return 1
    if r["common_share"] > 0.06 and r["cell_share"] < 0.3 and r["lead_share"] < 0.3:
        return 0
    if not strange and r["letter_share"] > 0.85 and (r["words_per_line"] > 4.5 or r["end_punct_share"] > 0.1) and r["cell_share"] < 0.2 and r["symbol_share"] < 0.03 and r["lead_share"] < 0.2:
        return 0
    return -1


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The frequent function words as a set. The table is fixed and small (178 words); more than 100,000 is an error."""
    rows = common_words.select("word").where("word is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words holds more than 100,000 words; it is meant to list function words only")
    return frozenset(r[0].lower() for r in rows)


def fit_kinds(x: np.ndarray, common: frozenset[str]) -> BoostedTrees:
    """Trees fitted on the weakly labelled rows of ``x`` and calibrated on the hand-checked holdout, which is never fitted.

    The hand-written EXAMPLES (no part of the holdout) are fitted too, so that a sample without some class, or an empty one, still gives a model.
    """
    from pagemill.llm.quality_holdout import EXAMPLES, HOLDOUT

    (hx, hy), (ex, ey) = ((np.array([features(t, common) for t, _ in rows]), np.array([KINDS.index(k) for _, k in rows])) for rows in (HOLDOUT, EXAMPLES))
    y = np.array([weak_label(dict(zip(FEATURES, row))) for row in x], dtype=int)
    x, y = (x[y >= 0], y[y >= 0]) if len(y) else (ex[:0], y)
    x, y = np.vstack([x, ex]), np.concatenate([y, ey])
    return BoostedTrees().fit(x, y, len(KINDS)).calibrate(hx, hy)


_KEYS = ("document_id", "page_no")


def page_statistics(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """(document_id, page_no, f array<float>): one row per distinct page row with a raw_text. Duplicate deliveries are dropped by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"document_id": pdf["document_id"], "page_no": pdf["page_no"], "f": [np.array(features(t, common), "f4") for t in pdf["raw_text"]]})

    return pages.where("raw_text is not null").select("document_id", "page_no", "raw_text").mapInPandas(run, "document_id string, page_no int, f array<float>")


def classify_pages(pages: DataFrame, common_words: DataFrame, fit_sample: int = FIT_SAMPLE) -> DataFrame:
    """One row per page with a raw_text: its statistics, kind (prose, list, table, junk) and probability.

    Columns: document_id, page_no, n_words, mean_word_len, symbol_share, end_punct_share, common_share, kind, confidence.
    Rows delivered twice count once (the row with the smallest statistics stands for a page whose deliveries differ).
    A null raw_text has no row; an empty or blank one is junk with zero statistics. Any length of text is read whole.

    The pages are read once; their statistics are written to the shared folder, from where the fitting sample of at most
    ``fit_sample`` rows goes to the driver and all rows are classified.
    """
    common = common_set(common_words)
    stats = write_through(page_statistics(pages, common), "stats")
    picked = smallest_hashes(stats, [*_KEYS], fit_sample).select("f").collect()
    model = fit_kinds(np.array([r[0] for r in picked], dtype=float).reshape(len(picked), len(FEATURES)), common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["f"].to_numpy()).astype(float)
                p = model.predict(x)
                p[x[:, 0] == 0] = (0, 0, 0, 1)
                out = pd.DataFrame({"document_id": pdf["document_id"], "page_no": pdf["page_no"], "n_words": x[:, 0].astype("int64")})
                for j, name in enumerate(FEATURES[1:5], 1):
                    out[name] = x[:, j]
                best = p.argmax(axis=1)
                yield out.assign(kind=[KINDS[b] for b in best], confidence=p[np.arange(len(p)), best])

    done = stats.mapInPandas(run, "document_id string, page_no int, n_words long, mean_word_len double, symbol_share double, end_punct_share double, common_share double, kind string, confidence double")
    cols = [c for c in done.columns if c not in _KEYS]
    return done.groupBy(*_KEYS).agg(F.min(F.struct(*cols)).alias("s")).select(*_KEYS, *[f"s.{c}" for c in cols])
