from __future__ import annotations

import random

import numpy as np
import pytest

from pagemill.llm import langid, quality, scan_noise, subjects
from pagemill.llm.gbt import BoostedTrees
from pagemill.llm.quality_holdout import HOLDOUT

COMMON = {
    "en": "the and of in to that with from by before after at all".split(),
    "bn": "এবং এই থেকে কিন্তু তার সেই".split(),
    "hi": "और का की के में से पर यह".split(),
    "mr": "आणि चा ची वर हे साठी".split(),
    "as": "আৰু এই পৰা কিন্তু তেওঁৰ লগত".split(),
}
EN = "The old river ran past the mill and the children of the village played in the water before the evening. "
BN = "এই নদীর তীরে অনেক মানুষ থাকে এবং তারা সকালে মাছ ধরে। সেই গ্রাম থেকে পথ দূরে যায় কিন্তু কেউ ফেরে না। "
HI = "यह नदी बहुत पुरानी है और लोग इस से पानी लेते हैं। गाँव का रास्ता पहाड़ से नीचे की ओर जाता है और दूर है। "
MR = "हे गाव नदी जवळ आहे आणि लोक सकाळी पाणी आणतात. डोंगर चा रस्ता खूप लांब आहे आणि मुले वर खेळतात. "
AS = "এই নদীৰ পাৰত বহুত মানুহ থাকে আৰু তেওঁলোকে ৰাতিপুৱা মাছ ধৰে। গাঁওৰ পৰা বাটটো দূৰলৈ যায় আৰু পাহাৰৰ লগত মিলে। "
RO = "ei nodir tire onek manush thake ebong tara sokale machh dhore. gram theke poth dure jae kintu keu phere na. "


def common_table(spark):
    return spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "language string, word string")


# --- problem 2 ---------------------------------------------------------------------------------------------


def test_trees_learn_and_calibrate():
    rng = np.random.RandomState(0)
    x = rng.rand(600, 4)
    y = (x[:, 0] > 0.5).astype(int) + 2 * (x[:, 1] > 0.7)
    model = BoostedTrees(rounds=15).fit(x[:400], y[:400], 4).calibrate(x[400:500], y[400:500])
    p = model.predict(x[500:])
    assert (p.argmax(1) == y[500:]).mean() > 0.93 and np.allclose(p.sum(1), 1)


def test_holdout_accuracy_without_holdout_in_training():
    common = frozenset(w for ws in COMMON.values() for w in ws)
    made = []
    rng = random.Random(4)
    for _ in range(60):
        made.append("\n".join(rng.choice([EN, BN, HI, MR]) for _ in range(3)))
        made.append("\n".join(rng.choice(["নদী", "lamp rope", "पानी", "• कलम", "গাছ পাতা"]) for _ in range(20)))
        made.append("\n".join(" | ".join(str(rng.randrange(999)) for _ in range(4)) for _ in range(8)))
        made.append("\n".join("".join(rng.choice("#$%^&*{}[]~ ") for _ in range(40)) for _ in range(5)))
    x = np.array([quality.features(t, common) for t in made])
    model = quality.fit_kinds(x, common)
    hx = np.array([quality.features(t, common) for t, _ in HOLDOUT])
    right = [quality.KINDS[k] == kind for k, (_, kind) in zip(model.predict(hx).argmax(1), HOLDOUT)]
    assert sum(right) >= 0.85 * len(right)


def test_holdout_is_never_fitted(monkeypatch):
    common = frozenset(w for ws in COMMON.values() for w in ws)
    fitted = []
    fit = BoostedTrees.fit
    monkeypatch.setattr(BoostedTrees, "fit", lambda self, x, y, k: fitted.extend(map(tuple, x)) or fit(self, x, y, k))
    quality.fit_kinds(np.empty((0, len(quality.FEATURES))), common)
    held = {tuple(quality.features(t, common)) for t, _ in HOLDOUT}
    assert fitted and not held & set(fitted)


def test_characters_beyond_the_basic_blocks_have_a_class():
    assert quality.features("川のほとりの村です", frozenset())[quality.FEATURES.index("letter_share")] > 0.9


def test_classify_pages(spark):
    rows = [(f"d{i}", 1, t) for i, (t, _) in enumerate(HOLDOUT)] * 2 + [("empty", 1, ""), ("blank", 1, " \n "), ("null", 1, None), ("long", 1, EN * 3000), (None, None, EN)]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, raw_text string").selectExpr("*", "'x' as kind", "1.0 as f")
    got = {r["document_id"]: r for r in quality.classify_pages(pages, common_table(spark)).collect()}
    assert len(got) == len(HOLDOUT) + 4 and "null" not in got
    assert got["empty"]["kind"] == got["blank"]["kind"] == "junk" and got["long"]["kind"] == got[None]["kind"] == "prose"
    assert got["long"]["n_words"] == len((EN * 3000).split())
    assert quality.classify_pages(pages.limit(0), common_table(spark)).count() == 0


def test_features_of_known_text():
    f = dict(zip(quality.FEATURES, quality.features("One two.\nThree the!", frozenset({"the"}))))
    assert f["n_words"] == 4 and f["end_punct_share"] == 1 and f["common_share"] == 0.25 and f["mean_word_len"] == pytest.approx(16 / 4)


# --- problem 7 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def profiles():
    pairs = [(EN * 5, "en"), (BN * 5, "bn"), (HI * 5, "hi"), (MR * 5, "mr"), (AS * 5, "as"), (RO * 5, "bn")]
    return langid.train(pairs, {k: set(v) for k, v in COMMON.items()})


@pytest.mark.parametrize("text,lang", [(EN, "en"), (BN, "bn"), (HI, "hi"), (MR, "mr"), (AS, "as"), (RO, "bn")])
def test_each_language(profiles, text, lang):
    found = langid.passages(text, profiles, frozenset())
    assert max(found, key=lambda p: p[1])[0] == lang


def test_mixed_page(profiles):
    found = langid.passages(BN * 2 + EN * 2 + BN, profiles, frozenset())
    assert [p[0] for p in found] == ["bn", "en", "bn"]
    assert [p[0] for p in langid.passages(BN + " river stone " + BN, profiles, frozenset())] == ["bn"]


@pytest.mark.parametrize("text", ["", " \n ", "১২৩ ৪৫", "123 - 456"])
def test_unreadable(profiles, text):
    assert langid.passages(text, profiles, frozenset()) == []


@pytest.mark.parametrize("label,code", [("bn_IN", "bn"), (" EN ", "en"), ("Assamese", "as"), ("mr-IN", "mr"), ("fr", "fr"), ("", None), (None, None)])
def test_labels(label, code):
    assert langid.label_code(label) == code


def test_wrong_labels(spark):
    texts = {"e": EN * 3, "b": BN * 3, "h": HI * 3, "x": BN * 3 + "\n\n" + EN * 3, "n": None, "blank": " "}
    pages = spark.createDataFrame([(k, 1, t) for k, t in texts.items()] * 2, "document_id string, page_no int, text string").selectExpr("*", "'q' as language")
    labels = {"e": "English", "b": None, "h": "en", "x": "bn-BD", "n": None, "blank": "und"}
    docs = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], "doc_id long, id string, language string").selectExpr("*", "1 as page_no")
    profiles, common = langid.fit_profiles(pages, docs, common_table(spark))
    got = {tuple(r) for r in langid.wrong_labels(langid.page_languages(pages, profiles, common), docs).collect()}
    assert got == {(1, 0, "bn"), (2, 0, "hi"), (3, 1, "bn"), (3, 1, "en")}
    assert langid.page_languages(pages.limit(0), profiles, common).count() == 0


# --- problem 10 --------------------------------------------------------------------------------------------

LAW = "The judge in the court heard the witness before the verdict. The attorney read the statute and the contract to the tribunal. "
SPORT = "The captain of the team hit the ball past the wicket. The bowler and the referee left the stadium after the tournament. "
PLAIN = "The old man walked along the river and sat under a tree in the evening. The children sang songs by the fire at night. "


def test_subjects(spark):
    rows = [(i, [LAW * 4, SPORT * 4, PLAIN * 4, LAW * 3 + "\n\n" + SPORT * 3][i % 4]) for i in range(80)] + [(900, None), (901, ""), (902, " \n "), (903, "court")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'scan.pdf' as filename", "'A' as source", "1 as subject", "2 as words")
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, title string")
    labels = spark.createDataFrame([(0, "law", "p"), (0, "law", "q"), (1, "law", "p"), (1, "sport", "q"), (2, "other", "p"), (None, "law", "p"), (5, None, "p")], "doc_id long, subject string, labelled_by string")
    got: dict[int, set] = {}
    for r in subjects.subjects_found(docs, areas, labels).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    for i in range(80):
        assert got.get(i, set()) == [{"law"}, {"sport"}, set(), {"law", "sport"}][i % 4], i
    assert not got.keys() & {900, 901, 902, 903}
    assert subjects.subjects_found(docs.limit(0), areas, labels.limit(0)).count() == 0


def test_accuracies_follow_agreement():
    k = 3
    rng = random.Random(0)
    patterns = []
    for _ in range(4000):
        y = rng.randrange(k)
        votes = [y if rng.random() < a else rng.randrange(k) for a in (0.95, 0.9, 0.4, 0.6, 0.4)] + [31]
        p = 0
        for v in votes:
            p = p << 5 | v
        patterns.append((p, 1))
    posterior, accuracy = subjects.learn_accuracies(patterns, k)
    assert accuracy["lexicon"] > accuracy["address"] > accuracy["source"] - 0.1
    assert all(abs(q.sum() - 1) < 1e-9 for q in posterior.values())


# --- problem 1 ---------------------------------------------------------------------------------------------

BOOK = "আমাদের গ্রামের পাশে একটি নদী আছে। সেই নদী থেকে সবাই জল আনে। সকালে ছেলেরা মাঠে খেলা করে এবং বিকেলে ঘরে ফেরে। পুরনো বটগাছের তলায় মেলা বসে দেশ-বিদেশের লোক আসে।".split()


def scanned(rng, page, title="সবুজ গ্রাম নদী"):
    words = [rng.choice(BOOK) for _ in range(70)]
    lines, truth, line = [], [], []
    if page % 2:
        lines.append(f"{title}    {page}")
        truth.append("header")
    for w in words:
        line.append(w)
        if len(line) == 7:
            lines.append(" ".join(line))
            truth.append("body")
            line = []
    lines.append(f"- {page} -")
    truth.append("pageno")
    return lines, truth


def test_noisy_lines(spark):
    rng = random.Random(6)
    pages, gold, want = [], [], set()
    for p in range(1, 61):
        lines, truth = scanned(rng, p)
        body = [i for i, t in enumerate(truth) if t == "body"]
        clean = " ".join(lines[i] for i in body)
        if p % 3 == 0:
            lines[body[1]] = lines[body[1]].rsplit(" ", 1)[0] + " গ্রামে-"
            lines[body[2]] = "র " + lines[body[2]]
            want.add(("d", p, body[1] + 1, "split"))
        if p % 4 == 0:
            lines[body[4]] += " নদ৩ী"
            want.add(("d", p, body[4] + 1, "misread"))
        if p % 5 == 0:
            lines[body[5]] = lines[body[5]].rsplit(" ", 1)[0] + " দেশ-"
            lines[body[6]] = "বিদেশের " + lines[body[6]]
        want |= {("d", p, i + 1, t) for i, t in enumerate(truth) if t != "body"}
        pages.append(("d", p, "ocr", "\n".join(lines)))
        gold.append(("d", p, clean))
    layer = [("t", i, "textlayer", " ".join(rng.choice(BOOK) for _ in range(60))) for i in range(40)]
    other = [("d", 100, "ocr", "• কলম\n• খাতা\n• বই\n• ছাতা\n• চক"), ("d", 101, "ocr", ""), ("d", 102, "ocr", None), ("d", 103, "ocr", "à¦¨à¦¦à§€ à¦¨à¦¦à§€"), ("e", 1, "needs_ocr", None)]
    df = spark.createDataFrame(pages + pages[:7] + layer + other, "document_id string, page_no int, source string, raw_text string").selectExpr("*", "'x' as role", "'y' as facts")
    docs = spark.createDataFrame([("d", "সবুজ গ্রাম নদী.pdf"), ("t", None)], "id string, filename string")
    gold_df = spark.createDataFrame(gold[:40], "document_id string, page_no int, gold_text string")
    got = {tuple(r) for r in scan_noise.noisy_lines(df, docs, gold_df, common_table(spark)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    fixed = {r["page_no"]: r["repaired"] for r in scan_noise.repair_pages(df, docs, gold_df, common_table(spark)).collect()}
    assert set(fixed) == set(range(1, 61))
    assert "দেশ-বিদেশের" in fixed[5] and "গ্রামের" in fixed[3] and "নদ৩ী" not in fixed[4] and "সবুজ গ্রাম নদী" not in fixed[1]
    assert scan_noise.noisy_lines(df.limit(0), docs, gold_df.limit(0), common_table(spark)).count() == 0


@pytest.mark.parametrize("line,number", [("১২", True), ("- 4 -", True), ("Page 12", True), ("[৩]", True), ("২ / ৬৩", True), ("~ ১ ~", True), ("vii", True), (".১", True), ("১২ জন লোক", False), ("নদী", False), ("[১২।৩]।", False)])
def test_page_number_pattern(line, number):
    assert bool(scan_noise._PAGENO.match(line)) == number


@pytest.mark.parametrize("token,core", [("নদী।", "নদী"), ("[২৫।৬৪]।", ""), ("t0ok", "t0ok"), ("॥১২॥", ""), ("barn5.", "barn5"), ("(river),", "river")])
def test_core(token, core):
    assert scan_noise.core(token) == core


def test_untrained_model_still_labels():
    lines = ["নদীর কথা   ৩", "সেই নদী থেকে সবাই জল আনে এবং ঘরে ফেরে।", "- ৩ -"]
    filled, rows = scan_noise.line_features(lines, {}, "")
    assert scan_noise.train_lines([]).decode(rows)[1:] == ["body", "pageno"]


def test_segments_of_a_page(spark, profiles):
    a, b = (BN + " ") * 2, (EN + " ") * 2
    text = a + b + "\n\n" + BN
    rows = [("d", 1, text), ("d", 1, text), ("d", 2, BN + " river stone " + BN), ("d", 3, None), ("d", 4, "")]
    pages = spark.createDataFrame(rows, "document_id string, page_no int, text string").selectExpr("*", "'x' as language")
    out = sorted(langid.page_segments(pages, profiles, frozenset()).collect(), key=lambda r: (r["page_no"], r["segment_no"]))
    one = [r for r in out if r["page_no"] == 1]
    assert [r["language"] for r in one] == ["bn", "en", "bn"] and all(0 < r["confidence"] <= 1 for r in one)
    assert [text[r["char_start"] : r["char_end"]] for r in one] == [a.strip(), b.strip(), BN.strip()]
    two = [r for r in out if r["page_no"] == 2]
    assert [(r["language"], r["n_words"]) for r in two] == [("bn", 2 * len(BN.split()) + 2)] and len(out) == 4
    assert langid.page_segments(pages.limit(0), profiles, frozenset()).count() == 0


# --- problem 1, paragraphs -------------------------------------------------------------------------------------


def test_breaks_make_the_paragraphs():
    rng = random.Random(3)
    sample = []
    for p in range(40):
        lines, gold = [], []
        for _ in range(4):
            words = [rng.choice(BOOK).strip("।") for _ in range(rng.randrange(12, 30))]
            words[-1] += "।"
            gold.append(" ".join(words))
            rows = [words[i : i + 7] for i in range(0, len(words), 7)]
            lines += ["   " + " ".join(rows[0])] + [" ".join(r) for r in rows[1:]]
        sample.append(("\n".join(lines + [f"- {p} -"]), "\n".join(gold), {}, ""))
    model = scan_noise.train_lines(sample[:30])
    same = [[" ".join(x.split()) for x in scan_noise.repaired(raw, facts, title, model).split("\n")] == gold.split("\n") for raw, gold, facts, title in sample[30:]]
    assert sum(same) >= 9
    labels = scan_noise.gold_labels(sample[0][0].split("\n"), list(range(sample[0][0].count("\n") + 1)), sample[0][1])
    assert labels.count("break") == 4 and labels[-1] == "pageno"


def test_deletion_keys_meet_at_one_edit():
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abকখ") for _ in range(rng.randrange(1, 9)))
        at = rng.randrange(len(word))
        for other in (word[:at] + word[at + 1 :], word[:at] + "x" + word[at + 1 :], word[:at] + "x" + word[at:]):
            assert set(scan_noise.deletion_keys(word)) & set(scan_noise.deletion_keys(other))
    assert set(scan_noise.deletion_keys("ab")) == {*scan_noise.deletion_keys("ab")} and len(scan_noise.deletion_keys("x" * 100_000)) == 2


def test_corrections_of_short_and_long_words(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(60))
    words = spark.createDataFrame([("at", 9), ("river", 5), (long, 3)], "word string, n long")
    unknown = spark.createDataFrame([("ab",), ("rivr",), (long[:30] + "z" + long[31:],)], "word string")
    got = {r["word"]: r["fix"] for r in scan_noise.corrections(unknown, words).collect()}
    assert got == {"ab": "at", "rivr": "river", long[:30] + "z" + long[31:]: long}
