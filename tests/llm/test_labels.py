from __future__ import annotations

from pagemill.llm import subjects
from pagemill.llm.sampling import smallest_hashes


def test_every_label_votes(spark, monkeypatch):
    n = 20_500
    docs = spark.range(n).selectExpr("id as doc_id", "'the court heard the witness' as text", "'scan.pdf' as filename", "'A' as source")
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, title string")
    labels = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'law', 'other') as subject")
    seen: list = []
    learn = subjects.learn_accuracies
    monkeypatch.setattr(subjects, "learn_accuracies", lambda patterns, k: seen.extend(patterns) or learn(patterns, k))
    subjects.document_subjects(docs, areas, labels)
    votes: dict[int, int] = {}
    for pattern, words in seen:
        votes[pattern & 31] = votes.get(pattern & 31, 0) + words
    assert votes == {0: 5 * n // 2, 2: 5 * n // 2}  # law, none of the subjects; no words without a label's vote


COOKING = "The cook stirred the soup in the kettle and tasted the broth. A pinch of saffron went into the oven with the dough. "
LAW = "The judge in the court heard the witness before the verdict. The attorney read the statute and the contract to the tribunal. "
PLAIN = "The old man walked along the river and sat under a tree in the evening. The children sang songs by the fire at night. "


def corpus(spark):
    docs = spark.createDataFrame([(i, [COOKING * 4, LAW * 4, PLAIN * 4][i % 3]) for i in range(90)], "doc_id long, text string").selectExpr("*", "'scan.pdf' as filename", "'A' as source")
    labels = spark.createDataFrame([(i, ["cooking", "law", "other"][i % 3]) for i in range(24)], "doc_id long, subject string")
    return docs, spark.createDataFrame([("law", "Law"), ("cooking", "Cooking")], "subject string, title string"), labels


def test_a_subject_without_seeds_is_learned_from_its_labels(spark):
    docs, areas, labels = corpus(spark)
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects_found(docs, areas, labels).collect()}
    assert got == {(i, ["cooking", "law"][i % 3]) for i in range(90) if i % 3 < 2}
    without = {(r["doc_id"], r["subject"]) for r in subjects.subjects_found(docs, areas, labels.limit(0)).collect()}
    assert without == {(i, "law") for i in range(90) if i % 3 == 1}


def test_words_beyond_the_sent_lexicon_count_too(spark):
    docs, areas, labels = corpus(spark)
    few, all_ = (sorted(map(tuple, subjects.document_subjects(docs, areas, labels, n).collect())) for n in (3, 100_000))
    assert len(all_) >= 60 and few == all_


def test_samples_are_the_rows_with_the_smallest_hashes(spark):
    df = spark.range(20_000).selectExpr("id as k", "id * 2 as v").repartition(7)
    plain = df.selectExpr("*", "xxhash64(k) as h").orderBy("h", "k").limit(300)
    assert [r["k"] for r in smallest_hashes(df, ["k"], 300).collect()] == [r["k"] for r in plain.collect()]
    assert smallest_hashes(df, ["k"], 30_000).count() == 20_000 and smallest_hashes(df.limit(0), ["k"], 5).count() == 0
