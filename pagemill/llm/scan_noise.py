"""Problem 1: noise in text from scanned pages, and its repair.

The lines of a page are labelled header, page number, break (running text that begins a paragraph or verse line) or body (running text that goes on) by a linear conditional
model over layout features (a linear-chain model: line features and transitions, decoded with Viterbi, weights learned by the averaged perceptron on the gold
pages). Paragraphs are put together from these labels. Words broken at a line end and misread words are told by the vocabulary of the pages that came with a text layer.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.encoding import find_spans
from pagemill.llm.quality import FEATURES, _classes, common_set, features, weak_label
from pagemill.llm.sampling import smallest_hashes
from pagemill.sources.shared import write_through

#: Gold pages that the line model is trained on at most (those with the smallest hash of their key), and rounds of training.
FIT_SAMPLE, ROUNDS = 2000, 6
#: So many of the most frequent words go to every worker, to spare the shuffle of words that are surely right; all others are looked up by a join.
TOP_WORDS = 20_000
#: Words of a line that may be looked for on other pages as a running header; a longer line is running text.
HEADER_WORDS = 8
#: Signs that mark a word as broken at the line end.
BREAKS = "-‐­¬"

_NUMBER = r"(?:[0-9০-৯०-९]{1,5}|[ivxlc]{1,6})"
_PAGENO = re.compile(
    rf"^\s*(?:[-–—~|•.*]+\s*|[\[(]\s*|page\s+|p\.\s*|পৃষ্ঠা\s+|পৃষ্ঠাঙ্ক\s+|পৃঃ?\s*|पृष्ठ\s+|पान\s+|পিঠি\s+|prishtha\s+)?{_NUMBER}(?:\s*(?:/|of|-)\s*{_NUMBER})?\s*(?:[-–—~|•.*]+|[\])])?\s*$", re.I)
_SIDE = re.compile(r"^\s*[0-9০-৯०-९]+\s{2,}\S|\S\s{2,}[0-9০-৯०-९]+\s*$")
_EDGE = ".,;:!?।॥|\"'()[]{}“”‘’—–~•●£*/…"
_LETTER = re.compile(r"[^\W\d_]")
_TERMINAL = "।॥.?!"
_VERSE = re.compile(r"[।॥.,;?!]\s*$")


def nfc(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def core(token: str) -> str:
    """The token without punctuation around it; empty when no letter is left."""
    bare = token.strip(_EDGE)
    return bare if _LETTER.search(bare) or any("ऀ" <= c <= "৿" and c not in "।॥" and not c.isdigit() for c in bare) else ""


def line_key(line: str) -> str:
    """A line without digits, punctuation and case, to find it again on other pages."""
    return "".join(c for c in line.lower() if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"))


def readable(text: str) -> bool:
    """A cheap test that a text is words rather than junk or cells."""
    marks = text.translate(_classes())
    v, c, i, s, d, y = (marks.count(x) for x in "vcisdy")
    letters, n = v + c + i, len(text.split())
    if not n or (letters + s) < 0.75 * (letters + s + d + y) or len(text) > 20 * n:
        return False
    if i < v + c:
        return v > 0.27 * (v + c)
    return s > 0.2 * i and len(re.findall(r"(?<![^ \n])s", marks)) < 0.1 * n


# --- vocabulary -------------------------------------------------------------------------------------------


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for text in pdf["raw_text"]:
            text = nfc(text)
            if readable(text) and not find_spans(text):
                seen = {core(w) for w in text.split()}
                counts.update(seen | {w.lower() for w in seen} | {x for w in seen if "-" in w for x in w.split("-")})
        counts.pop("", None)
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())}).astype({"word": str, "n": "int64"})


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n): words of the pages with a text layer and the number of those pages; counted over all of them, pre-aggregated by task."""
    return pages.where("source = 'textlayer' and raw_text is not null").select("raw_text").mapInPandas(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- what a page needs to know ----------------------------------------------------------------------------


def is_running_text(text: str, common: frozenset[str]) -> bool:
    """Prose or verse, not garbled, not empty."""
    return bool(text.strip()) and not find_spans(text) and weak_label(dict(zip(FEATURES, features(text, common)))) in (0, -1)


def asked(text: str, known: frozenset[str] | set[str]) -> set[tuple[str, str]]:
    """(role, word) that a page's decisions depend on: w word, j the two halves of a broken word joined, k the halves kept with a hyphen, h a line that may be a header."""
    out: set[tuple[str, str]] = set()
    lines = [x.split() for x in nfc(text).split("\n")]
    filled = [x for x in lines if x]
    for i, words in enumerate(filled):
        for w in words:
            c = core(w)
            if c and c not in known:
                out.add(("w", c))
                if c.lower() != c:
                    out.add(("w", c.lower()))
                if "-" in c.strip("-"):
                    out.update(("w", x) for x in c.split("-") if x and x not in known)
        last = words[-1]
        if len(last) > 1 and last[-1] in BREAKS:
            for nxt in filled[i + 1 :]:  # as far as a line that can be no header
                head, tail = last[:-1].lstrip(_EDGE), nxt[0].rstrip(_EDGE)
                out |= {("j", head + tail), ("k", head + "-" + tail), ("j", (head + tail).lower()), ("w", head), ("w", tail)}
                if len(nxt) > HEADER_WORDS:
                    break
        if len(words) <= HEADER_WORDS and words[-1][-1] not in _TERMINAL and (key := line_key(" ".join(words))):
            out.add(("h", key))
    return out


def _ask(common: frozenset[str], known: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, text in zip(pdf["document_id"], pdf["page_no"], pdf["raw_text"]):
                if is_running_text(text, common):
                    rows.append((doc, page, "p", ""))
                    rows += [(doc, page, role, word) for role, word in asked(text, known)]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "role", "word"]).astype({"page_no": "Int32"})

    return run


def page_facts(pages: DataFrame, documents: DataFrame, common_words: DataFrame, top_words: int = TOP_WORDS) -> tuple[DataFrame, DataFrame, frozenset[str]]:
    """(facts, vocabulary, known): facts has document_id, page_no, title and facts (array of role, word, n) for each OCR page of running text."""
    words = write_through(vocabulary(pages), "vocabulary")
    known = frozenset(r[0] for r in words.orderBy(F.desc("n"), "word").limit(top_words).select("word").collect())
    common = common_set(common_words)
    ocr = pages.where("source = 'ocr' and raw_text is not null").select("document_id", "page_no", "raw_text")
    asked_rows = write_through(ocr.mapInPandas(_ask(common, known), "document_id string, page_no int, role string, word string"), "asked")
    keys = ["document_id", "page_no"]
    looked = asked_rows.where("role in ('w', 'j', 'k')").join(words, "word", "left")
    # of plain words only the unknown are told, of joined ones only the known
    told = looked.where("(role = 'w') = (n is null)").select(*keys, "role", "word", F.coalesce("n", F.lit(0)).alias("n"))
    heads = asked_rows.where("role = 'h'").distinct()
    often = heads.groupBy("document_id", "word").agg(F.count("*").alias("n")).where("n > 1")
    heads = heads.join(often, ["document_id", "word"]).select(*keys, "role", "word", "n")
    marks = asked_rows.where("role = 'p'").select(*keys, "role", "word", F.lit(0).cast("long").alias("n"))
    grouped = told.unionByName(heads).unionByName(marks).groupBy(*keys).agg(F.collect_set(F.struct("role", "word", "n")).alias("facts"))
    titles = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("title")).groupBy("document_id").agg(F.min("title").alias("title"))
    return write_through(grouped.join(titles, "document_id", "left"), "facts"), words, known


# --- the line model ---------------------------------------------------------------------------------------

STATES = ("body", "break", "header", "pageno")
#: States of running text.
RUNNING = ("body", "break")


def line_features(lines: list[str], facts: dict[tuple[str, str], int], title: str) -> tuple[list[int], list[list[str]]]:
    """(numbers, features) of the lines that aren't blank."""
    filled = [i for i, x in enumerate(lines) if x.strip("​﻿ \t\r")]
    usual = median(len(lines[i]) for i in filled) if filled else 0
    shapes = []
    for k, i in enumerate(filled):
        x = lines[i].strip()
        words = x.split()
        key = line_key(x) if len(words) <= HEADER_WORDS else ""
        shapes.append((x, words, key, bool(_PAGENO.match(x))))
    # lines between blank lines, and whether most of them end like verse
    blocks = [0] * len(filled)
    for k in range(1, len(filled)):
        blocks[k] = blocks[k - 1] + (filled[k] != filled[k - 1] + 1)
    members: dict[int, list[bool]] = defaultdict(list)
    for k, b in enumerate(blocks):
        members[b].append(bool(_VERSE.search(shapes[k][0])))
    verse = {b: len(ends) > 1 and sum(ends[:-1]) >= 0.6 * (len(ends) - 1) for b, ends in members.items()}
    out = []
    for k, i in enumerate(filled):
        x, words, key, pageno = shapes[k]
        top, bottom = min(k, 3), min(len(filled) - 1 - k, 3)
        n = len(words)
        size = str(n) if n < 5 else "5+" if n < 8 else "8+"
        end = "t" if x[-1] in _TERMINAL else "c" if x[-1] in ",;:" else "b" if x[-1] in BREAKS and n > 1 else "-"
        seen = facts.get(("h", key), 1) if key else 1
        titled = bool(key and title and (key == title or (abs(len(key) - len(title)) <= 2 and len(title) > 5 and _near(key, title))))
        gap_before = k == 0 or filled[k - 1] != i - 1
        gap_after = k + 1 == len(filled) or filled[k + 1] != i + 1
        prev_end = "s" if k == 0 else "t" if shapes[k - 1][0][-1] in _TERMINAL else "p" if shapes[k - 1][3] else "-"
        short = len(x) < 0.62 * usual
        verse_end = k > 0 and bool(_VERSE.search(shapes[k - 1][0]))
        prev_short = k > 0 and len(shapes[k - 1][0]) < 0.8 * usual
        indent = lines[i][:1] in " \t\u3000"
        place = f"{'T' if top == 0 else 'B' if bottom == 0 else 'u' if top == 1 else 'v' if bottom == 1 else 'm'}"
        f = [
            "1", f"n{size}", f"end{end}", f"pl{place}", f"pn{pageno}", f"pn{pageno}{place}", f"pn{pageno}{n}", f"side{bool(_SIDE.search(x))}", f"seen{min(seen, 4)}",
            f"ti{titled}", f"ti{titled}{end}", f"g{gap_before:d}{gap_after:d}", f"sh{short:d}", f"pe{prev_end}", f"np{k + 1 < len(filled) and shapes[k + 1][3]:d}",
            f"pl{place}n{size}{end}", f"pl{place}n{size}{end}s{min(seen, 3)}", f"sh{short:d}{place}{end}{prev_end}", f"seen{min(seen, 3)}{end}{size}",
            f"up{x.upper() == x and x.lower() != x:d}", f"dig{any(c.isdigit() for c in x):d}{size}{end}", f"g{gap_before:d}{gap_after:d}{place}{size}{end}",
            f"par{gap_before:d}", f"par{gap_before:d}{prev_end}{prev_short:d}", f"vs{verse[blocks[k]]:d}{verse_end:d}", f"vs{verse[blocks[k]]:d}{verse_end:d}{gap_before:d}{prev_end}", f"in{indent:d}{gap_before:d}",
            f"cap{x[:1].isupper():d}{place}{size}{end}", f"np{k + 1 < len(filled) and shapes[k + 1][3]:d}{size}{end}{prev_end}",
        ]
        out.append(f)
    return filled, out


def _near(a: str, b: str) -> bool:
    """Whether two short strings differ in at most two places (insertions and deletions included)."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


class LineModel:
    """Weights of (state, feature) and (state, next state); starts from what the page-number pattern says."""

    def __init__(self) -> None:
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self.w.update({("pageno", "pnTrue"): 2.0, ("body", "pnFalse"): 1.0, ("body", "n8+"): 1.0, ("header", "tiTrue"): 2.0, ("header", "sideTrue"): 1.0, ("header", "seen4"): 1.0, ("break", "par1"): 1.5, ("break", "vs11"): 1.5, ("break", "pnFalse"): 0.5, ("break", "n8+"): 1.0})
        self.t: dict[tuple[str, str], float] = defaultdict(float)

    def freeze(self) -> "LineModel":
        """Weights as plain numbers, by feature, for fast decoding."""
        self.by_feature: dict[str, list[float]] = {}
        for (state, feature), value in self.w.items():
            if value:
                self.by_feature.setdefault(feature, [0.0] * len(STATES))[STATES.index(state)] = value
        self.trans = [[self.t.get((a, b), 0.0) for b in STATES] for a in STATES]
        self.w, self.t = {}, {}
        return self

    def decode(self, rows: list[list[str]]) -> list[str]:
        best, back = [0.0] * len(STATES), []
        for k, f in enumerate(rows):
            local = [0.0] * len(STATES)
            if hasattr(self, "by_feature"):
                for x in f:
                    if (v := self.by_feature.get(x)) is not None:
                        local = [a + b for a, b in zip(local, v)]
            else:
                local = [sum(self.w.get((s, x), 0.0) for x in f) for s in STATES]
            if k == 0:
                best = local
                continue
            trans = self.trans if hasattr(self, "trans") else [[self.t.get((a, b), 0.0) for b in STATES] for a in STATES]
            step, came = [], []
            for b in range(len(STATES)):
                scores = [best[a] + trans[a][b] for a in range(len(STATES))]
                a = max(range(len(STATES)), key=scores.__getitem__)
                step.append(scores[a] + local[b])
                came.append(a)
            best = step
            back.append(came)
        if not rows:
            return []
        path = [max(range(len(STATES)), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return [STATES[s] for s in reversed(path)]

    def train(self, pages: list[tuple[list[list[str]], list[str]]], rounds: int = ROUNDS) -> "LineModel":
        """Averaged perceptron; pages in the given order. Without pages the starting weights stay."""
        total_w: dict[tuple[str, str], float] = defaultdict(float)
        total_t: dict[tuple[str, str], float] = defaultdict(float)
        step = 1
        for _ in range(rounds):
            for rows, truth in pages:
                guess = self.decode(rows)
                if guess != truth:
                    for k, (g, y) in enumerate(zip(guess, truth)):
                        if g != y:
                            for x in rows[k]:
                                self.w[y, x] += 1.0
                                self.w[g, x] -= 1.0
                                total_w[y, x] += step
                                total_w[g, x] -= step
                        if k and (guess[k - 1], g) != (truth[k - 1], y):
                            self.t[truth[k - 1], y] += 1.0
                            self.t[guess[k - 1], g] -= 1.0
                            total_t[truth[k - 1], y] += step
                            total_t[guess[k - 1], g] -= step
                step += 1
        for key, value in total_w.items():
            self.w[key] -= value / step
        for key, value in total_t.items():
            self.t[key] -= value / step
        return self.freeze()


def gold_labels(lines: list[str], filled: list[int], gold: str) -> list[str]:
    """State of each line by the page's gold text: what the gold text lacks is header or page number, what begins one of its lines is a break."""
    flat = " ".join(nfc(gold).split())
    words = set(flat.split())
    begun = [x.split() for x in nfc(gold).split("\n") if x.strip()]
    firsts, seconds = {tuple(x[:2]) for x in begun}, {tuple(x[1:3]) for x in begun if len(x) > 2}
    out = []
    for k, i in enumerate(filled):
        own = lines[i].split()
        kept = sum(w in words for w in own) / len(own)
        if " ".join(own) in flat and not (_PAGENO.match(lines[i].strip()) and kept < 1):
            out.append("pageno" if _PAGENO.match(lines[i].strip()) and f" {own[0]} " not in f" {flat} " else "body")
        elif _PAGENO.match(lines[i].strip()):
            out.append("pageno")
        else:
            pairs = [f" {a} {b} " in f" {flat} " for a, b in zip(own, own[1:])]
            out.append("body" if len(own) > 5 or own[-1][-1] in _TERMINAL or (sum(pairs) >= 0.34 * len(pairs) if pairs else kept == 1) else "header")
        if out[-1] == "body" and (tuple(own[:2]) in firsts or (len(own) > 2 and tuple(own[1:3]) in seconds) or (len(own) == 1 and any(x[0] == own[0] for x in begun))):
            out[-1] = "break"
    return out


def fact_map(facts) -> dict[tuple[str, str], int]:
    return {(f["role"], f["word"]): f["n"] for f in facts}


def title_key(filename: str | None) -> str:
    """The document's title as its file is named, as a line key; empty for names that say nothing."""
    if not filename:
        return ""
    name = re.sub(r"\.[A-Za-z]{3,4}$", "", filename)
    return "" if re.match(r"(?i)(upload|scan)[_ \d]*$", name) else line_key(re.sub(r"\(\d+\)\s*$", "", name))


def train_lines(sample: list[tuple[str, str, dict, str]]) -> LineModel:
    """Model from (raw text, gold text, facts, title key) of gold pages."""
    pages = []
    for raw, gold, facts, title in sample:
        lines = nfc(raw).split("\n")
        filled, rows = line_features(lines, facts, title)
        if rows:
            pages.append((rows, gold_labels(lines, filled, gold)))
    return LineModel().train(pages)


# --- findings and repair ----------------------------------------------------------------------------------


def _unknown(token: str, facts: dict) -> bool:
    """Whether a token of running text is misread: a word that no text-layer page has, or a mark in a place of its own."""
    c = core(token)
    if not c:
        return token in ("|", "/", "\\", "l") or (len(token) > 1 and token[-1] == "/" and token[0] not in "([")
    if token[-1] == "/" and len(token) > 2:
        return True
    if ("w", c) not in facts:
        return False
    if c.lower() != c and ("w", c.lower()) not in facts:
        return False
    parts = [x for x in c.split("-") if x]
    return not (len(parts) > 1 and all(("w", x) not in facts for x in parts))


def is_split(head: str, tail: str, sign: str, facts: dict) -> bool:
    """Whether head and tail are halves of one word (and not the parts of a compound broken at its own hyphen)."""
    joined = max(facts.get(("j", head + tail), 0), facts.get(("j", (head + tail).lower()), 0))
    compound = facts.get(("k", head + "-" + tail), 0)
    if joined or compound:
        return joined >= compound
    return sign != "-" or not (head and tail and ("w", head) not in facts and ("w", tail) not in facts)


def read_page(raw: str, facts: dict, title: str, model: LineModel) -> tuple[list[str], list[int], list[str], dict[int, int]]:
    """(lines, numbers of filled lines, their states, broken: index of a body line -> index of the line that goes on)."""
    lines = nfc(raw).split("\n")
    filled, rows = line_features(lines, facts, title)
    states = model.decode(rows)
    for k, i in enumerate(filled):  # a page number is what looks like one
        if (states[k] == "pageno") != (states[k] not in RUNNING and bool(_PAGENO.match(lines[i].strip()))):
            states[k] = "body" if states[k] == "pageno" else "pageno"
    body = [i for i, s in zip(filled, states) if s in RUNNING]
    broken = {}
    for a, b in zip(body, body[1:]):
        words = lines[a].split()
        last = words[-1]
        if len(last) > 1 and last[-1] in BREAKS:
            tail = lines[b].split()[0].rstrip(_EDGE)
            # a number or reference is broken when its bracket is still open or the sign is no plain hyphen
            if is_split(last[:-1].lstrip(_EDGE), tail, last[-1], facts) if core(last) else last[-1] != "-" or last.count("[") > last.count("]"):
                broken[a] = b
    return lines, filled, states, broken


def findings(raw: str, facts: dict, title: str, model: LineModel) -> list[tuple[int, str]]:
    """(line_no, kind) of a page, from 1."""
    lines, filled, states, broken = read_page(raw, facts, title, model)
    goes_on = set(broken.values())
    out = []
    for i, state in zip(filled, states):
        if state not in RUNNING:
            out.append((i + 1, state))
            continue
        if i in broken:
            out.append((i + 1, "split"))
        words = lines[i].split()
        hyphened = len(words[-1]) > 1 and words[-1][-1] in BREAKS
        inner = words[(i in goes_on) : len(words) - hyphened]
        if any(_unknown(w, facts) for w in inner):
            out.append((i + 1, "misread"))
    return out


def repaired(raw: str, facts: dict, title: str, model: LineModel) -> str:
    """Running text of a page: headers and page numbers gone, broken words joined, misread words replaced where the facts name a correction (role f), one
    line per paragraph or verse line."""
    lines, filled, states, broken = read_page(raw, facts, title, model)
    body = [(i, s == "break") for i, s in zip(filled, states) if s in RUNNING]
    fixes = {word.split("\t")[0]: word.split("\t")[1] for role, word in facts if role == "f"}
    goes_on = set(broken.values())
    text, prev = "", None
    for i, begins in body:
        words = [w.replace(core(w), fixes[core(w)]) if core(w) in fixes and _unknown(w, facts) else w for w in lines[i].split()]
        line = " ".join(words)
        if prev is not None:
            if i in goes_on:
                text = text[:-1]  # without the sign of the break
            elif begins:
                text += "\n\n" if any(not lines[x].strip() for x in range(prev + 1, i)) else "\n"
            elif not re.search(rf"\S\S*[{BREAKS}]$", text) or not core(text.rsplit(None, 1)[-1]):
                text += " "
            elif text[-1] != "-":
                text = text[:-1] + "-"
        text += line
        prev = i
    return "\n".join(" ".join(x.split()) for x in text.split("\n"))


def _joined(pages: DataFrame, facts: DataFrame) -> DataFrame:
    ocr = pages.where("source = 'ocr' and raw_text is not null").select("document_id", "page_no", "raw_text")
    return ocr.join(facts, ["document_id", "page_no"])


def line_model(pages: DataFrame, facts: DataFrame, gold_pages: DataFrame, fit_sample: int = FIT_SAMPLE) -> LineModel:
    """The line model, trained on at most ``fit_sample`` gold pages; without any the starting weights."""
    keys = ["document_id", "page_no"]
    gold = smallest_hashes(gold_pages.where("gold_text is not null").select(*keys, "gold_text"), keys, fit_sample)
    rows = _joined(pages, facts).join(F.broadcast(gold), keys).orderBy(*keys).collect()  # gold has at most fit_sample rows
    return train_lines([(r["raw_text"], r["gold_text"], fact_map(r["facts"]), title_key(r["title"])) for r in rows])


def noisy_lines(pages: DataFrame, documents: DataFrame, gold_pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(document_id, page_no, line_no, kind): header, pageno, split and misread lines of OCR pages of running text.

    Garbled pages, lists, tables, junk, null and blank texts have no rows. Equal deliveries count once. Words are looked up in the vocabulary by a join after the
    most frequent ones were set aside, so nothing that grows with the corpus is broadcast; texts are read whole and shuffled once, by page.
    """
    facts, _, _ = page_facts(pages, documents, common_words)
    model = pages.sparkSession.sparkContext.broadcast(line_model(pages, facts, gold_pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, page, n, kind)
                for doc, page, raw, own, title in zip(pdf["document_id"], pdf["page_no"], pdf["raw_text"], pdf["facts"], pdf["title"])
                for n, kind in findings(raw, fact_map(own), title_key(title), model.value)
            ]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "line_no", "kind"]).astype({"page_no": "Int32", "line_no": "Int32"})

    return _joined(pages, facts).mapInPandas(run, "document_id string, page_no int, line_no int, kind string").distinct()


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def deletion_keys(word: str) -> list[int]:
    """Hashes of the word and of the word without each of its characters, in time linear in its length."""
    before = [0]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
    out, after, power = {before[-1]}, 0, 1
    for i in range(len(word) - 1, -1, -1):  # ``after`` is the hash of what follows i, ``power`` is _BASE to its length
        out.add((before[i] * power + after) % _PRIME)
        after = (after + ord(word[i]) * power) % _PRIME
        power = power * _BASE % _PRIME
    return sorted(out)


def corrections(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(word, fix): the most frequent vocabulary word one insertion, deletion or substitution away. Both sides meet on their one-letter deletions, by a join."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(part=[deletion_keys(w) for w in pdf["word"]])

    left = unknown.select("word").distinct().mapInPandas(spread, "word string, part array<long>").withColumn("part", F.explode("part"))
    right = words.select(F.col("word"), "n").mapInPandas(spread, "word string, n long, part array<long>").withColumn("part", F.explode("part")).select(F.col("word").alias("fix"), "n", "part")
    near = left.join(right, "part").where((F.levenshtein("word", "fix", 1) >= 0) & (F.col("word") != F.col("fix")))
    return near.groupBy("word").agg(F.max(F.struct("n", "fix")).alias("m")).select("word", "m.fix")


def repair_pages(pages: DataFrame, documents: DataFrame, gold_pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(document_id, page_no, repaired): the running text of every OCR page that noisy_lines looks at, one line per paragraph or verse line."""
    facts, words, _ = page_facts(pages, documents, common_words)
    keys = ["document_id", "page_no"]
    flat = facts.select(*keys, F.explode("facts").alias("f")).where("f.role = 'w'").select(*keys, F.col("f.word").alias("word"))
    fixes = flat.join(corrections(flat, words), "word").groupBy(*keys).agg(
        F.collect_set(F.struct(F.lit("f").alias("role"), F.concat_ws("\t", "word", "fix").alias("word"), F.lit(0).cast("long").alias("n"))).alias("fixes"))
    full = facts.join(fixes, keys, "left").withColumn("facts", F.when(F.col("fixes").isNull(), F.col("facts")).otherwise(F.concat("facts", "fixes"))).drop("fixes")
    model = pages.sparkSession.sparkContext.broadcast(line_model(pages, facts, gold_pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [repaired(raw, fact_map(own), title_key(title), model.value) for raw, own, title in zip(pdf["raw_text"], pdf["facts"], pdf["title"])]
            yield pdf[keys].assign(repaired=out)

    return _joined(pages, full).mapInPandas(run, "document_id string, page_no int, repaired string").distinct()
