"""Problem 7: the language of each document and of each segment of a page, with a confidence.

Rank-order profiles: each language (in each script it is written in) has a profile of its most frequent character n-grams, in
order of frequency; a segment's own most frequent n-grams are compared with a profile by the out-of-place distance. Profiles are
trained on a bounded sample of pages whose sentences are recognised by their function words; sentences in a script that no
listed function word is written in (a language in foreign letters) get a profile under the language that most of their documents claim.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.encoding import clean
from pagemill.llm.quality import FEATURES, features, weak_label
from pagemill.llm.sampling import smallest_hashes

LANGUAGES = ("bn", "en", "hi", "as", "mr")
#: Spellings of a language label, without case, outer blanks and what follows a hyphen or underscore. Fixed values.
SPELLINGS = {
    "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn", "বাংলা": "bn",
    "en": "en", "eng": "en", "english": "en",
    "hi": "hi", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "हिंदी": "hi",
    "as": "as", "asm": "as", "assamese": "as", "অসমীয়া": "as",
    "mr": "mr", "mar": "mr", "marathi": "mr", "मराठी": "mr",
}
#: Pages read to train the profiles (those with the smallest hash of their key), and n-grams of a profile.
FIT_SAMPLE, PROFILE = 1500, 400
#: A segment is cut after so many words at the latest; a passage of another language has at least so many words.
SEGMENT_WORDS, PASSAGE_WORDS = 24, 10
#: Words of the other script in a row that begin a new segment.
SCRIPT_RUN = 3

_COUNT = itemgetter(1)
_END = re.compile(r"[।॥.?!]+[\"'”’)\]]*$")
_BENG, _DEVA, _LATN = re.compile("[ঀ-৿]"), re.compile("[ऀ-ॣॐ-ॿ]"), re.compile("[A-Za-zÀ-ɏ]")
_BLANK_LINE, _WORD = re.compile(r"\n\s*\n"), re.compile(r"\S+")
_LETTERS = re.compile(r"[^\d\W_]|[\u0900-\u0963\u0980-\u09e3]|['’]")


def script_of(word: str) -> str:
    """B, D or L by the word's first letter of such a script, else empty."""
    for name, pattern in (("B", _BENG), ("D", _DEVA), ("L", _LATN)):
        if pattern.search(word):
            return name
    return ""


class _Words:
    """Script and n-grams of words, kept while the worker lives (bounded)."""

    def __init__(self, most: int = 200_000):
        self.most, self.kept = most, {}

    def __call__(self, word: str) -> tuple[str, str, tuple[str, ...]]:
        got = self.kept.get(word)
        if got is None:
            script = script_of(word)
            bare = "".join(c for c in word.lower() if c.isalpha() or "\u0900" <= c <= "\u0963" or "\u0980" <= c <= "\u09e3" or c in "'’-").strip("'’-")
            padded = f"_{bare}_"
            grams = tuple(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_") if bare else ()
            if len(self.kept) >= self.most:
                self.kept.clear()
            got = self.kept[word] = (script if bare else "", bare, grams)
        return got


_words = _Words()


def placed_segments(text: str) -> list[tuple[str, list[str], int, int]]:
    """(script, words, char_start, char_end) of the segments of a text: cut at sentence ends, blank lines, lasting changes of script and after SEGMENT_WORDS words.

    A word without letters, and up to SCRIPT_RUN - 1 words of another script, stay in the segment they stand in.
    """
    out: list[tuple[str, list[str], int, int]] = []

    def close(script: str, marks: list[re.Match]) -> None:
        if marks:
            out.append((script, [m[0] for m in marks], marks[0].start(), marks[-1].end()))

    at = 0
    for gap in chain(_BLANK_LINE.finditer(text), (None,)):
        script, own, alien = "", [], []
        for m in _WORD.finditer(text, at, gap.start() if gap else len(text)):
            word = m[0]
            s = _words(word)[0]
            if s and script and s != script:
                alien.append(m)
                if len(alien) >= SCRIPT_RUN:
                    close(script, own)
                    script, own, alien = s, alien, []
            else:
                if alien and s:
                    own, alien = own + alien, []
                (alien if alien else own).append(m)
                script = script or s
            if _END.search(word) or len(own) + len(alien) >= SEGMENT_WORDS:
                if len(alien) >= SCRIPT_RUN:
                    close(script, own)
                    close(script_of("".join(x[0] for x in alien)), alien)
                else:
                    close(script, own + alien)
                script, own, alien = "", [], []
        close(script, own + alien)
        at = gap.end() if gap else at
    return out


def segments(text: str) -> list[tuple[str, list[str]]]:
    """(script, words) of the segments of a text."""
    return [x[:2] for x in placed_segments(text)]


def ranked(words: list[str], most: int) -> list[str]:
    """The most frequent n-grams, most frequent first; equal counts in order of appearance."""
    counts = Counter(chain.from_iterable([_words(w)[2] for w in words]))
    return [g for g, _ in sorted(counts.items(), key=_COUNT, reverse=True)[:most]]


class Profiles:
    """Profiles by script: {script: {language: {n-gram: rank}}}."""

    def __init__(self, by_script: dict[str, dict[str, dict[str, int]]]):
        self.by_script = by_script
        self.tables = {}
        for script, profiles in by_script.items():
            langs = sorted(profiles)
            index = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
            ranks = np.full((len(langs), len(index) + 1), 4 * PROFILE, dtype="i4")  # what a profile lacks is further than any rank
            for k, lang in enumerate(langs):
                for g, r in profiles[lang].items():
                    ranks[k, index[g]] = r
            self.tables[script] = langs, index, ranks

    def identify(self, script: str, words: list[str]) -> tuple[str, float, float]:
        """(language, confidence, distance) by the out-of-place distance: the mean difference between an n-gram's rank here and in the profile, at most
        PROFILE for each, scaled to 0 to 1. The confidence is the lead over the next language of the script."""
        if script not in self.tables:
            return "", 0.0, 1.0
        langs, index, ranks = self.tables[script]
        grams = ranked(words, PROFILE)
        if not grams:
            return "", 0.0, 1.0
        get, lacking = index.get, len(index)
        at = np.array([get(g, lacking) for g in grams])
        distance = np.minimum(np.abs(ranks[:, at] - np.arange(len(at), dtype="i4")), PROFILE).sum(1) / (len(at) * PROFILE)
        order = distance.argsort(kind="stable")
        best = float(distance[order[0]])
        if len(langs) == 1:
            return langs[0], 1.0, best
        second = float(distance[order[1]])
        return langs[order[0]], (second - best) / second if second > 0 else 0.0, best


def train(texts: list[tuple[str, str | None]], common: dict[str, set[str]]) -> Profiles:
    """Profiles from (text, claimed language) pairs and the function words of each language.

    A sentence counts for the language most of its function words belong to (two at least, twice those of any other language).
    Sentences without any function word, in a script where such sentences are common, form the profile of the language claimed most often for them.
    """
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    loose: dict[str, Counter] = defaultdict(Counter)
    claims: dict[str, Counter] = defaultdict(Counter)
    scripts: Counter = Counter()
    for lang, listed in common.items():
        for w in listed:
            counts[script_of(w), lang].update(_words(w)[2])
    for text, claimed in texts:
        for script, words in segments(clean(text)):
            if not script or len(words) < 5:
                continue
            scripts[script] += 1
            grams = Counter(chain.from_iterable(_words(w)[2] for w in words))
            hits = Counter(lang for w in words for lang, listed in common.items() if _words(w)[1] in listed)
            top = hits.most_common(2)
            if not top:
                if sum(c.isdigit() for w in words for c in w) * 5 < sum(map(len, words)) and _END.search(words[-1]):
                    loose[script].update(grams)
                    if claimed:
                        claims[script][claimed] += 1
            elif top[0][1] >= 2 and (len(top) < 2 or top[0][1] >= 2 * top[1][1]):
                counts[script, top[0][0]].update(grams)
    by_script: dict[str, dict[str, dict[str, int]]] = defaultdict(dict)
    for (script, lang), c in counts.items():
        by_script[script][lang] = {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])}
    for script, c in loose.items():
        lang = max(claims[script].items(), key=lambda x: (x[1], x[0]), default=("", 0))[0]
        if lang and (script, lang) not in counts and sum(claims[script].values()) >= 0.02 * scripts[script]:
            by_script[script][lang] = {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE])}
    return Profiles(dict(by_script))


#: A page whose words are further than this from every profile is tested for being junk.
STRANGE = 0.62
#: The lead that a segment needs to differ from the segments around it.
SURE = 0.08


def placed_passages(text: str, profiles: Profiles, common: frozenset[str]) -> list[tuple[str, int, float, int, int]]:
    """(language, words, confidence, char_start, char_end) of the passages of a text, in order. Nothing for an empty or unreadable text. Offsets are into the text with its encoding put right."""
    text = clean(text)
    found = [(*profiles.identify(s, w), len([x for x in w if _words(x)[0]]), s, start, end) for s, w, start, end in placed_segments(text)]
    found = [f for f in found if f[0]]
    if not found:
        return []
    total = sum(f[3] for f in found)
    if sum(f[2] * f[3] for f in found) > STRANGE * total and weak_label(dict(zip(FEATURES, features(text, common)))) == 3:
        return []
    # the main language of each script on this page settles short and doubtful segments
    main: dict[str, Counter] = defaultdict(Counter)
    for lang, lead, _, n, s, *_ in found:
        main[s][lang] += n * min(lead, 0.3)
    out: list[list] = []
    waiting = 0
    for lang, lead, _, n, s, start, end in found:
        if n < SCRIPT_RUN and n < total:  # a few words of another script are no segment of their own: they count where they stand
            if out:
                out[-1][1], out[-1][4] = out[-1][1] + n, end
            else:
                waiting += n
            continue
        usual = main[s].most_common(1)[0][0]
        if lang != usual and (lead < SURE or n < 4):
            lang = usual
        if out and out[-1][0] == lang:
            out[-1][1] += n
            out[-1][2] += lead * n
            out[-1][4] = end
        else:
            out.append([lang, n + waiting, lead * n, start, end])
            waiting = 0
    return [(lang, n, round(weighted / max(n, 1), 4), start, end) for lang, n, weighted, start, end in out]


def passages(text: str, profiles: Profiles, common: frozenset[str]) -> list[tuple[str, int, float]]:
    """(language, words, confidence) of the passages of a text."""
    return [x[:3] for x in placed_passages(text, profiles, common)]


def label_code(name: str | None) -> str | None:
    """The code of a language label in any spelling, ``missing`` as None, another language as itself."""
    if name is None:
        return None
    short = re.split(r"[-_]", name.strip().lower())[0].strip()
    return SPELLINGS.get(short, short or None)


def label_column(name: Column) -> Column:
    """``label_code`` of a column."""
    short = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(name, r"^(?U:\s)+|(?U:\s)+$", ""), "[-_]"), 1)))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, short), short)


def fit_profiles(pages: DataFrame, documents: DataFrame, common_words: DataFrame, fit_sample: int = FIT_SAMPLE) -> tuple[Profiles, frozenset[str]]:
    """Profiles from a sample of at most ``fit_sample`` pages, and the function words. An empty corpus leaves the profiles of the function words alone."""
    rows = common_words.where("word is not null").select("language", "word").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words holds more than 100,000 words; it is meant to list function words only")
    common: dict[str, set[str]] = defaultdict(set)
    for lang, word in rows:
        if label_code(lang) in LANGUAGES:
            common[label_code(lang)].add(word.lower())
    picked = smallest_hashes(pages.where("text is not null").select("document_id", "page_no", "text"), ["document_id", "page_no"], fit_sample)
    claimed = documents.select(F.col("id").alias("document_id"), "language")
    sample = picked.join(claimed, "document_id", "left").collect()
    profiles = train([(r["text"], c if (c := label_code(r["language"])) in LANGUAGES else None) for r in sample], common)
    return profiles, frozenset(w for listed in common.values() for w in listed)


def page_languages(pages: DataFrame, profiles: Profiles, common: frozenset[str]) -> DataFrame:
    """One row per page and language: document_id, page_no, language, n_words, longest (words of the longest passage), confidence.

    Equal deliveries of a page count once; a page delivered with different texts has the rows of each. No text is shuffled.
    """
    sent = pages.sparkSession.sparkContext.broadcast((profiles, common))  # at most 15 profiles of PROFILE n-grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof, words = sent.value
        for pdf in batches:
            out = []
            for doc, page, text in zip(pdf["document_id"], pdf["page_no"], pdf["text"]):
                by: dict[str, list] = {}
                for lang, n, conf in passages(text, prof, words):
                    x = by.setdefault(lang, [0, 0, 0.0])
                    x[0], x[1], x[2] = x[0] + n, max(x[1], n), x[2] + conf * n
                out += [(doc, page, lang, n, longest, c / max(n, 1)) for lang, (n, longest, c) in by.items()]
            yield pd.DataFrame(out, columns=["document_id", "page_no", "language", "n_words", "longest", "confidence"]).astype({"page_no": "Int32"})

    kept = pages.where("text is not null").select("document_id", "page_no", "text")
    return kept.mapInPandas(run, "document_id string, page_no int, language string, n_words long, longest long, confidence double").distinct()


def page_segments(pages: DataFrame, profiles: Profiles, common: frozenset[str]) -> DataFrame:
    """One row per passage of one language of each page text: document_id, page_no, segment_no (from 1), char_start, char_end, language, n_words, confidence.

    Offsets are into the page's text with its encoding put right. Null, empty and unreadable texts have no rows; equal deliveries count once.
    """
    sent = pages.sparkSession.sparkContext.broadcast((profiles, common))  # at most 15 profiles of PROFILE n-grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof, words = sent.value
        columns = ["document_id", "page_no", "segment_no", "char_start", "char_end", "language", "n_words", "confidence"]
        for pdf in batches:
            rows = [
                (doc, page, i, start, end, lang, n, conf)
                for doc, page, text in zip(pdf["document_id"], pdf["page_no"], pdf["text"])
                for i, (lang, n, conf, start, end) in enumerate(placed_passages(text, prof, words), 1)
            ]
            yield pd.DataFrame(rows, columns=columns).astype({"page_no": "Int32"})

    kept = pages.where("text is not null").select("document_id", "page_no", "text")
    return kept.mapInPandas(run, "document_id string, page_no int, segment_no int, char_start int, char_end int, language string, n_words long, confidence double").distinct()


def document_languages(found: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document with a readable page: doc_id, language (the one most of its words are in), confidence (share of words times mean lead), label
    (``language`` as a code, null when empty), claimed (the label as stored)."""
    by_doc = found.groupBy("document_id", "language").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    best = by_doc.groupBy("document_id").agg(F.max(F.struct("n", "language", "c")).alias("m"), F.sum("n").alias("total"))
    docs = documents.select("doc_id", F.col("id").alias("document_id"), F.col("language").alias("claimed"))
    return docs.join(best, "document_id").where("m.n > 0").select(
        "doc_id", "document_id", F.col("m.language").alias("language"), F.round(F.col("m.c") / F.col("total"), 4).alias("confidence"),
        F.when(F.length(F.trim(F.coalesce("claimed", F.lit("")))) > 0, label_column(F.col("claimed"))).alias("label"), "claimed")


def wrong_labels(found: DataFrame, documents: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, page_no, language): page_no 0 for documents with a missing or wrong label; page_no >= 1 for each language of a page that
    holds passages of at least ``least_words`` words in two or more languages."""
    docs = document_languages(found, documents).where("label is null or label != language").select("doc_id", F.lit(0).alias("page_no"), "language")
    long = found.where(F.col("longest") >= least_words).select("document_id", "page_no", "language").distinct()
    mixed = long.withColumn("k", F.count("*").over(Window.partitionBy("document_id", "page_no"))).where("k > 1")
    ids = documents.select(F.col("id").alias("document_id"), "doc_id")
    return docs.unionByName(mixed.join(ids, "document_id").select("doc_id", "page_no", "language"))
