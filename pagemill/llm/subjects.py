"""Problem 10: the subjects of each document.

Labelling functions vote on the subject of each passage: the lexicon (a sticky chain over sentences), the passage's raw word hits, the section it stands in
(the passage before it), the address (words of the file's name), the source (what its other passages are about) and the hand labels of its document. A
latent model learns each function's accuracy from how the votes agree over the whole corpus (expectation maximisation over counts of vote
patterns) and gives each pattern a posterior over subjects; a document has the subjects that enough of its words belong to.

The lexicon starts from the seed roots below, or for a subject without them from its title and its hand-labelled documents, and grows by the words that keep company with
these in the corpus.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.encoding import clean
from pagemill.sources.shared import write_through

#: Seed roots of each subject in English, Bengali and Assamese (prefixes of inflected words), Hindi, Marathi, and Bengali in Latin letters. Fixed values.
SEEDS = {
    "scripture": "scripture prayer mantra ritual hymn temple worship meditation পূজা যজ্ঞ মন্ত্র বেদী প্রার্থনা উপাসনা শ্লোক স্তোত্র আহুতি পূজা যজ্ঞ মন্ত্ৰ প্ৰাৰ্থনা স্তোত্ৰ पूजा यज्ञ मंत्र वेदी प्रार्थना उपासना श्लोक स्तोत्र आहुति puja jojn montr bedi prarthona upasona shlok ahuti stotr",
    "law": "court judge attorney lawyer tribunal verdict statute contract witness appeal আদালত মামলা বিচারক উকিল দণ্ড আইন আসামি সাক্ষী চুক্তি আপিল আদালত উকীল বিচাৰক साक्षी न्यायालय न्यायाधीश मुकदमा वकील दंड क़ानून अनुबंध अपील करार खटला कायदा adalot mamola bicharok ukil asami sakshi chukti apil dolil",
    "science": "science theory planet atom molecule equation acid microscope gravity chemistry particle বিজ্ঞান তত্ত্ব গ্রহ পরমাণু সমীকরণ অম্ল অণুবীক্ষণ মহাকর্ষ রসায়ন তরঙ্গ গ্ৰহ সমীকৰণ মহাকৰ্ষ পৰমাণু ৰসায়ন विज्ञान सिद्धांत ग्रह परमाणु समीकरण अम्ल रसायन तरंग गुरुत्व अणु somikoron bijnan porman omlo omlti rosaen mohakorsh onubikshon",
    "sport": "wicket referee stadium captain tournament swimmer medal bowler goal player coach team উইকেট বোলার খেলোয়াড় ম্যাচ কোচ পদক অধিনায়ক প্রতিযোগিতা গোল সাঁতার ব্যাট উইকেট বোলাৰ কোচ পদক খেলুৱৈ প্ৰতিযোগিতা विकेट गेंदबाज़ खिलाड़ी मैदान पदक कप्तान मुकाबला प्रतियोगिता प्रशिक्षक बल्ला खेळाडू गोलंदाज स्पर्धा khelar kheloear bolar mjach odhinaek protijogita podok koch uiket sãtar",
    "software": "software computer database password server browser compiler algorithm program সফটওয়্যার কম্পিউটার ডাটাবেস পাসওয়ার্ড সার্ভার ব্রাউজার কম্পাইলার অ্যালগরিদম প্রোগ্রাম ফাইল সফটওয়্যাৰ কম্পিউটাৰ পাসওয়াৰ্ড সাৰ্ভাৰ ব্ৰাউজাৰ প্ৰোগ্ৰাম सॉफ़्टवेयर कंप्यूटर डेटाबेस पासवर्ड सर्वर ब्राउज़र कंपाइलर एल्गोरिद्म प्रोग्राम फ़ाइल sophtoear kompiutar databes pasoard sarbhar braujar kompailar ojalogoridom progr",
    "farming": "plough irrigation fertiliser pesticide harvest barn seedling crop cattle seed wheat কীটনাশক সেচ লাঙল ধান ফসল জমি কৃষক গরু গম পাট বীজ চারা মাড়াই কৃষক গৰু ধান সাৰ লাঙল सिंचाई फ़सल किसान बैल गेहूँ जूट बीज पौधा खाद हल मड़ाई खेत शेतकरी पीक kitonashok langol phosol krishok maraiti maraie dhanguli sech",
    "health": "hospital doctor patient nurse vaccine medicine fever disease lung blood surgery infection nutrition হাসপাতাল চিকিৎসক রোগী নার্স টিকা ওষুধ জ্বর রোগ ফুসফুস রক্ত সংক্রমণ পুষ্টি হৃদযন্ত্র হাস্পতাল চিকিৎসক ৰোগী নাৰ্স ঔষধ জ্বৰ ৰোগ ৰক্ত सংक्रमण अस्पताल चिकित्सक रोगी परिचारिका टीका औषधि ज्वर रोग रक्त संक्रमण पोषण हृदय फेफड़ा रुग्णालय hasopatal chikitsok rogi nars tika oshudh jbor phusophus sngkromon pushti hridojontr",
    "history": "king empire throne revolt dynasty inscription fortress campaign treaty century soldier independence capital রাজা রাজবংশ সাম্রাজ্য বিদ্রোহ সিংহাসন দুর্গ অভিযান সন্ধি শতাব্দী সৈন্য যুদ্ধ স্বাধীনতা নবাব শিলালিপি ৰাজা ৰাজবংশ দুৰ্গ বিদ্ৰোহ মুদ্ৰা राजा राजवंश साम्राज्य विद्रोह सिंहासन किला अभियान संधि शताब्दी सैनिक युद्ध स्वतंत्रता सूबेदार शिलालेख मुद्रा raja rajobngsh samrajj bidroh singhason durg obhijan sondhi shotabdi soinj juddh sbadhinota nobab shilalip",
}
#: Roots shorter than this must match a word whole.
ROOT_LEAST = 4
#: A word joins the lexicon with at least so many sentences, this share of its sentences in one subject's company, and this share of all company it keeps.
GROW_COUNT, GROW_SHARE, GROW_PURE = 4, 0.3, 0.7
#: And with so many times the share that the subject's company has of all sentences.
GROW_LIFT = 1.8
#: Words of the lexicon that are sent to every worker at most (the most frequent); a document's words among the rest are looked up by a join.
LEXICON_MOST = 500_000
#: Labelled documents that roots of unlisted subjects are learned from at most, and in how many of a subject's documents such a root must stand.
LABEL_SAMPLE, LABEL_DOCS = 2000, 3
#: A document has a subject that at least this share of its words, and so many words, belong to.
SHARE, LEAST_WORDS = 0.25, 8

_EDGE = ".,;:!?।॥|\"'()[]{}“”‘’—–-‐•●*/"
_CELLS = re.compile(r"[\s;|]+")
#: Characters and marks that were put into texts by accident and belong to no word.
_STRAY = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]|<\\|endoftext\\|>")
_SENTENCE = re.compile(r"(?<=[।॥?!.])\s+|\n\s*\n")


def words_of(sentence: str) -> list[str]:
    return [b for w in _CELLS.split(sentence) if (b := w.strip(_EDGE).lower())]


def sentences(text: str) -> list[list[list[str]]]:
    """Words of the sentences of each paragraph; a sentence without an end is cut after 25 words."""
    out = []
    for paragraph in re.split(r"\n\s*\n", _STRAY.sub("", text)):
        rows = []
        for s in _SENTENCE.split(paragraph):
            w = words_of(s)
            rows += [w[i : i + 25] for i in range(0, len(w), 25)]
        if rows:
            out.append(rows)
    return out


class Seeds(dict):
    """Subject of a word (-1: none): by ``first`` (a lexicon), else by the seed roots, else by ``learned`` roots of subjects that have no seeds. Remembered for repeated words (bounded)."""

    def __init__(self, subjects: list[str], learned: dict[str, int] | None = None, first: dict[str, int] | None = None):
        super().__init__()
        self.first = first or {}
        self.whole: dict[str, int] = dict(learned or {})
        self.roots: dict[str, int] = {}
        for k, subject in enumerate(subjects):
            for root in SEEDS.get(subject, "").split():
                (self.roots if len(root) >= ROOT_LEAST else self.whole)[root] = k
        self.sizes = sorted({len(r) for r in self.roots}, reverse=True)

    def __missing__(self, word: str) -> int:
        got = self.first.get(word, -1)
        if got < 0:
            got = self.whole.get(word, -1)
        if got < 0 and len(word) >= ROOT_LEAST:
            got = next((self.roots[word[:n]] for n in self.sizes if word[:n] in self.roots and len(word) - n <= 6), -1)
        if len(self) > 300_000:
            self.clear()
        self[word] = got
        return got


def learned_roots(docs: DataFrame, labels: DataFrame, areas: list[tuple[str, str | None]]) -> dict[str, int]:
    """word -> subject number for the subjects that SEEDS doesn't list: the words of their titles, and words that in the hand-labelled documents belong to them.

    A word belongs to a subject when it stands in at least LABEL_DOCS of its labelled documents, and most labelled documents that it stands in have that subject. Fitted on
    the labelled documents (doc_id, label) with the smallest hashes, at most LABEL_SAMPLE; every label votes on its own document all the same.
    """
    unlisted = [k for k, (subject, _) in enumerate(areas) if subject not in SEEDS]
    if not unlisted:
        return {}
    out = {w: k for k in unlisted for w in words_of(areas[k][1] or "") if len(w) >= ROOT_LEAST}
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_SAMPLE)
    rows = docs.join(F.broadcast(picked), "doc_id").select("label", "text").limit(4 * LABEL_SAMPLE).collect()  # at most LABEL_SAMPLE labels are broadcast
    counts: dict[str, Counter] = {}
    for r in rows:
        for w in {w for p in sentences(clean(r["text"])) for s in p for w in s}:
            counts.setdefault(w, Counter())[r["label"]] += 1
    for w, c in counts.items():
        label, n = c.most_common(1)[0]
        if label in unlisted and n >= LABEL_DOCS and n >= 0.7 * sum(c.values()) and len(w) > 1:
            out.setdefault(w, label)
    return out


def _company(subjects: list[str], learned: dict[str, int]):
    """(word, subject or -1, n): sentences of a paragraph whose other words' seeds point to one subject; -1 counts all sentences of a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed = Seeds(subjects, learned)
        for pdf in batches:
            # all sentences, then those of each subject; the empty word stands for all words
            counts = [Counter() for _ in range(len(subjects) + 1)]
            for text in pdf["text"]:
                for paragraph in sentences(clean(text)):
                    for s in paragraph:
                        distinct = set(s)
                        counts[-1].update(distinct)
                        counts[-1][""] += 1
                        hits = [k for w in s if (k := seed[w]) >= 0]
                        if hits:
                            top, n = Counter(hits).most_common(1)[0] if len(hits) > 1 else (hits[0], 1)
                            if n * 3 >= 2 * len(hits):
                                counts[top][""] += 1
                                # a seed is no company to itself
                                counts[top].update(distinct if n > 1 else [w for w in distinct if seed[w] < 0])
            rows = [(w, k if k < len(subjects) else -1, n) for k, c in enumerate(counts) for w, n in c.items()]
            yield pd.DataFrame(rows, columns=["word", "subject", "n"]).astype({"word": str, "subject": "int32", "n": "int64"})

    return run


def grow_lexicon(docs: DataFrame, subjects: list[str], learned: dict[str, int], most: int = LEXICON_MOST) -> tuple[dict[str, int], DataFrame | None]:
    """(word -> subject number, rest): counted over all documents. The ``most`` most frequent words come to the driver; ``rest`` has the others (word, subject), None if there are none."""
    counts = docs.mapInPandas(_company(subjects, learned), "word string, subject int, n long").groupBy("word", "subject").agg(F.sum("n").alias("n"))
    counts = write_through(counts, "company")
    base = {r["subject"]: r["n"] for r in counts.where("word = ''").collect()}  # one row a subject
    usual = F.create_map(*[F.lit(x) for k in range(-1, len(subjects)) for x in (k, base.get(k, 0) / max(base.get(-1, 1), 1))])
    with_subject = F.when(F.col("subject") >= 0, F.struct("n", "subject"))
    best = counts.groupBy("word").agg(F.max(with_subject).alias("m"), F.sum(F.when(F.col("subject") >= 0, F.col("n"))).alias("company"), F.max(F.when(F.col("subject") < 0, F.col("n"))).alias("total"))
    good = best.where(
        (F.col("m.n") >= GROW_COUNT) & (F.col("m.n") >= GROW_SHARE * F.col("total")) & (F.col("m.n") >= GROW_LIFT * usual[F.col("m.subject")] * F.col("total")) & (F.col("m.n") >= GROW_PURE * F.col("company")) & (F.length("word") > 1) & F.col("word").rlike(r"^[^\d০-৯०-९]+$"))
    good = write_through(good.select("word", F.col("m.subject").alias("subject"), F.col("m.n").alias("n")), "lexicon")
    rows = good.orderBy(F.desc("n"), "word").limit(most + 1).collect()
    if len(rows) <= most:
        return {r["word"]: r["subject"] for r in rows}, None
    last = rows[-1]
    rest = good.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") >= last["word"])))
    return {r["word"]: r["subject"] for r in rows[:-1]}, rest.select("word", "subject")


def rare_words(docs: DataFrame, lexicon: dict[str, int], rest: DataFrame) -> DataFrame:
    """(doc_id, rare): the words of each document that are in ``rest`` (a lexicon too large to send), by a join."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_MOST words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, w) for doc, text, name in zip(pdf["doc_id"], pdf["text"], pdf["filename"])
                for w in {*words_of(name or ""), *(w for p in sentences(clean(text)) for s in p for w in s)} if w not in sent.value
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "word"])

    return docs.select("doc_id", "text", "filename").mapInPandas(run, "doc_id long, word string").join(rest, "word").groupBy("doc_id").agg(F.collect_set(F.struct("word", "subject")).alias("rare"))


class Chain:
    """Sticky chain over sentences: which subject (or none, the last state) each is about, by its lexicon words."""

    def __init__(self, k: int, own: float = 0.2, stray: float = 0.004, none: float = 0.012, stay: float = 0.93, over: float = 0.75):
        self.k = k
        self.own, self.stray = np.log(own), np.log(stray)
        self.quiet = np.log(1 - own - stray * (k - 1))
        self.none, self.none_quiet = np.log(none / k), np.log(1 - none)
        self.stay = (np.log(stay), np.log((1 - stay) / k))
        self.over = (np.log(over), np.log((1 - over) / k))

    def decode(self, rows: list[tuple[int, dict[int, int], bool]]) -> list[int]:
        """rows: (words, hits by subject, begins a paragraph)."""
        k = self.k
        best = np.zeros(k + 1)
        back = []
        for i, (n, hits, begins) in enumerate(rows):
            total = sum(hits.values())
            local = np.full(k + 1, total * self.stray + (n - total) * self.quiet)
            local[k] = total * self.none + (n - total) * self.none_quiet
            for s, c in hits.items():
                local[s] += c * (self.own - self.stray)
            if i:
                stay, move = self.over if begins else self.stay
                top = int(best.argmax())
                moved = best[top] + move
                kept = best + stay
                came = np.where(kept >= moved, np.arange(k + 1), top)
                back.append(came)
                best = np.maximum(kept, moved)
            best = best + local
        if not rows:
            return []
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        return path[::-1]


FUNCTIONS = ("lexicon", "hits", "section", "address", "source", "labels")
_ABSTAIN = 31


def _votes(subjects: list[str], lexicon: dict[str, int], learned: dict[str, int]):
    """(doc_id, total, pattern, words): words of each document by the vote pattern of the passage they stand in. The places of the source and the labels are left open."""
    k = len(subjects)
    chain = Chain(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Seeds(subjects, learned, lexicon)
        for pdf in batches:
            rows = []
            extra = pdf["rare"] if "rare" in pdf else [None] * len(pdf)
            for doc, text, filename, rare in zip(pdf["doc_id"], pdf["text"], pdf["filename"], extra):
                units = []
                subject = known
                if rare is not None and len(rare):
                    subject = Seeds(subjects, learned, ChainMap({r["word"]: r["subject"] for r in rare}, lexicon))
                for paragraph in sentences(clean(text)):
                    for j, s in enumerate(paragraph):
                        hits: dict[int, int] = {}
                        for w in s:
                            h = subject[w]
                            if h >= 0:
                                hits[h] = hits.get(h, 0) + 1
                        units.append((len(s), hits, j == 0))
                states = chain.decode(units)
                named = Counter(h for w in words_of(filename or "") if (h := subject.first.get(w, -1)) >= 0)
                address = named.most_common(1)[0][0] if named else _ABSTAIN
                patterns: Counter = Counter()
                total, at, before = 0, 0, _ABSTAIN
                while at < len(units):
                    end = at
                    hits: Counter = Counter()
                    n = 0
                    while end < len(units) and states[end] == states[at]:
                        n += units[end][0]
                        hits.update(units[end][1])
                        end += 1
                    raw = hits.most_common(1)[0][0] if hits else k
                    pattern = 0
                    for vote in (states[at], raw, before, address, _ABSTAIN, _ABSTAIN):
                        pattern = pattern << 5 | vote
                    patterns[pattern] += n
                    total, before, at = total + n, states[at], end
                rows += [(doc, total, p, n) for p, n in patterns.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "total", "pattern", "words"]).astype("int64")

    return run


def learn_accuracies(patterns: list[tuple[int, int]], k: int, rounds: int = 25) -> tuple[dict[int, np.ndarray], dict[str, float]]:
    """(posterior over k subjects and none for each pattern, accuracy of each function) from (pattern, words) counts, by expectation maximisation.

    Given the true subject, a function that votes is right with its accuracy and else names any other; what is true has a learned prior. Accuracies begin at 0.95 for
    the lexicon, 0.8 for its hits, 0.5 for the section, 0.6 for the address, 0.4 for the source and 0.7 for the labels, and are kept between 0.05 and 0.99 so that logarithms stay finite.
    """
    m = len(FUNCTIONS)
    if not patterns:
        return {}, {}
    votes = np.array([[(p >> 5 * (m - 1 - j)) & 31 for j in range(m)] for p, _ in patterns])
    weight = np.array([float(n) for _, n in patterns])
    accuracy = np.array([0.95, 0.8, 0.5, 0.6, 0.4, 0.7])
    prior = np.full(k + 1, 1 / (k + 1))
    for _ in range(rounds):
        log = np.tile(np.log(prior), (len(votes), 1))
        for j in range(m):
            cast = votes[:, j] <= k
            log[cast] += np.log((1 - accuracy[j]) / k)
            rows = np.flatnonzero(cast)
            log[rows, votes[rows, j]] += np.log(accuracy[j]) - np.log((1 - accuracy[j]) / k)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        for j in range(m):
            rows = np.flatnonzero(votes[:, j] <= k)
            if len(rows) and weight[rows].sum() > 0:
                accuracy[j] = np.clip((weight[rows] * post[rows, votes[rows, j]]).sum() / weight[rows].sum(), 0.05, 0.99)
        prior = (weight[:, None] * post).sum(0) + 1
        prior /= prior.sum()
    return {p: post[i] for i, (p, _) in enumerate(patterns)}, dict(zip(FUNCTIONS, accuracy.round(4).tolist()))


def document_subjects(documents: DataFrame, subject_areas: DataFrame, subject_labels: DataFrame, lexicon_most: int = LEXICON_MOST) -> DataFrame:
    """One row per document with a non-blank text and subject it touches: doc_id, subject, words, total, share (expected share of its words, by the posterior).

    doc_id is unique; rows repeated with the same text count once. Null, empty and blank texts have no rows; labels of unknown subjects
    count as none of them; contradicting labels of a document are left out. Texts are read whole, twice, and not shuffled: the labels, all of
    them, are joined to the documents' patterns.
    """
    spark = documents.sparkSession
    areas = [(r[0], r[1]) for r in subject_areas.where("subject is not null").groupBy("subject").agg(F.min("title")).orderBy("subject").limit(31).collect()]
    subjects = [s for s, _ in areas]
    if len(subjects) > 30:
        raise ValueError("at most 30 subjects")
    k = len(subjects)
    docs = documents.where("text is not null and text rlike '\\\\S'").select("doc_id", "text", "filename", F.lower(F.trim("source")).alias("source"))
    number = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in enumerate(subjects)) for x in pair])
    labels = subject_labels.where("doc_id is not null and subject is not null").select("doc_id", F.coalesce(F.try_element_at(number, F.col("subject")), F.lit(k)).alias("s")).groupBy("doc_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    labels = labels.where("lo = hi").select("doc_id", F.col("lo").cast("long").alias("label"))
    learned = learned_roots(docs, labels, areas)
    lexicon, rest = grow_lexicon(docs.select("text"), subjects, learned, lexicon_most)
    if rest is not None:
        docs = docs.join(rare_words(docs, lexicon, rest), "doc_id", "left")
    sent = spark.sparkContext.broadcast(lexicon)  # at most LEXICON_MOST words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _votes(subjects, sent.value, learned)(batches)

    rows = write_through(docs.mapInPandas(run, "doc_id long, total long, pattern long, words long").dropDuplicates(["doc_id", "pattern"]), "votes")
    # the labels' place is the last of the pattern
    pattern = F.when(F.col("label").isNull(), F.col("pattern")).otherwise(F.col("pattern").bitwiseAND(F.lit(~31).cast("long")).bitwiseOR(F.col("label")))
    rows = rows.join(labels, "doc_id", "left").select("doc_id", "total", pattern.alias("pattern"), "words")
    # what a source is mostly about, for its vote: the lexicon's words by source
    first = F.shiftright("pattern", 5 * (len(FUNCTIONS) - 1)).bitwiseAND(31)
    by_source = documents.select("doc_id", F.lower(F.trim("source")).alias("source")).join(rows.select("doc_id", first.alias("s"), "words"), "doc_id").where((F.col("s") < k) & F.col("source").isNotNull())
    sums = by_source.groupBy("source", "s").agg(F.sum("words").alias("n")).groupBy("source").agg(F.max(F.struct("n", "s")).alias("m"), F.sum("n").alias("all")).where("m.n >= 0.5 * all").select("source", F.col("m.s").cast("long").alias("vote"))
    place = len(FUNCTIONS) - 1 - FUNCTIONS.index("source")
    rows = rows.join(documents.select("doc_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"]), "doc_id", "left").join(sums, "source", "left")
    mask = ~(31 << 5 * place)
    rows = rows.withColumn("pattern", F.when(F.col("vote").isNull(), F.col("pattern")).otherwise(F.col("pattern").bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.shiftleft("vote", 5 * place)))).select("doc_id", "total", "pattern", "words")
    seen = rows.groupBy("pattern").agg(F.sum("words").alias("n")).collect()  # at most (k + 2) ** 6 patterns; a few hundred in practice
    posterior, _ = learn_accuracies(sorted((r[0], r[1]) for r in seen), k)
    table = spark.createDataFrame([(p, subjects[s], float(q[s])) for p, q in posterior.items() for s in range(k) if q[s] > 1e-3], "pattern long, subject string, p double")
    belong = rows.join(F.broadcast(table), "pattern")
    return belong.groupBy("doc_id", "subject").agg(F.sum(F.col("words") * F.col("p")).alias("words"), F.max("total").alias("total")).select(
        "doc_id", "subject", F.round("words", 2).alias("words"), "total", F.round(F.col("words") / F.col("total"), 4).alias("share"))


def subjects_found(documents: DataFrame, subject_areas: DataFrame, subject_labels: DataFrame) -> DataFrame:
    """(doc_id, subject) of the subjects that at least SHARE of a document's words, and at least LEAST_WORDS words, belong to."""
    s = document_subjects(documents, subject_areas, subject_labels)
    return s.where((F.col("share") >= SHARE) & (F.col("words") >= LEAST_WORDS)).select("doc_id", "subject")
