from __future__ import annotations

import base64
import random
import re

import numpy as np
import pytest

from pagemill.llm import knn, mixing, neardup, split, tokenizer

WS = re.compile(r"[\t-\r \x85\xa0  -     　]")


# --- problem 3 ---------------------------------------------------------------------------------------------


def random_page(rng, n):
    words = [rng.choice(["নদী", "river", "ক", "longwordwithoutend", "গ্রাম।", "end.", "\n\n", "\n", "  "]) for _ in range(n)]
    return " ".join(words)


def check_chunks(text, rows, limit=700, lead=60):
    covered = 0
    before = None
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        a, b = r["char_start"], r["char_end"]
        assert r["text"] == text[a:b] and 0 < b - a <= limit
        assert not text[covered:a].strip() and a >= covered
        start = a if before is None else max(before, a - lead)
        assert r["embed_text"] == text[start:b]
        covered, before = b, a
    assert not text[covered:].strip()


@pytest.mark.parametrize("range_size", [128, 1000, 65_536])
def test_split_is_whole_and_within_limits(spark, range_size):
    rng = random.Random(5)
    texts = [random_page(rng, n) for n in (300, 800, 5000)] + ["x" * 2000, " " * 900, "a" * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (98, None), (99, "")], "k int, text string")
    out: dict[int, list] = {}
    for r in split.split_texts(df, ["k"], range_size=range_size).collect():
        out.setdefault(r["k"], []).append(r)
    for i, t in enumerate(texts[:4]):
        check_chunks(t, out[i])
    assert set(out) == {0, 1, 2, 3}


def test_split_does_not_depend_on_ranges(spark):
    text = random_page(random.Random(7), 6000)
    df = spark.createDataFrame([(1, text)], "k int, text string")
    a, b = (sorted(map(tuple, split.split_texts(df, ["k"], range_size=n).collect())) for n in (256, 65_536))
    assert a == b


def broken(chunks, texts):
    out = set()
    by: dict = {}
    for c in chunks:
        by.setdefault((c[1], c[2]), []).append(c)
    for key, rows in by.items():
        t = texts.get(key) or ""
        reach, prev = 0, None
        for i, _, _, _, cs, ce, text, embed, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            inside = lambda p: 0 < p < len(t) and not WS.match(t[p - 1]) and not WS.match(t[p])
            out |= {(i, "oversized")} if ce - cs > 700 else set()
            out |= {(i, "mid_word")} if (inside(cs) or inside(ce)) and WS.search(t[cs:ce]) else set()
            out |= {(i, "stale")} if t[cs:ce] != text else set()
            out |= {(i, "gap")} if any(not WS.match(x) for x in t[reach:cs]) else set()
            s = cs if prev is None else max(prev, cs - 60)
            out |= {(i, "overlap")} if embed != t[s:cs] + text else set()
            reach, prev = max(reach, ce), cs
    return out


@pytest.mark.parametrize("range_size", [64, 65_536])
def test_broken_chunks_against_brute_force(spark, range_size):
    from datetime import datetime

    rng = random.Random(11)
    texts, chunks = {}, []
    for d in range(12):
        t = random_page(rng, 120)
        texts[(f"d{d}", 1)] = t
        at, prev = 0, None
        for o in range(6):
            cs = min(max(0, at + rng.choice([0, 0, 0, 3, 90])), len(t))
            ce = min(cs + rng.choice([40, 80, 120, 750]), len(t))
            s = cs if prev is None else max(prev, cs - 60)
            body = t[cs:ce] if rng.random() < 0.8 else t[cs:ce][:-2] + "zz"
            embed = t[s:cs] + body if rng.random() < 0.8 else body
            chunks.append((f"d{d}:1:{o}", f"d{d}", 1, o, cs, ce, body, embed, datetime(2024, 1, 1)))
            at, prev = ce, cs
    chunks.append(("gone:1:0", "gone", 1, 0, 0, 3, "abc", "abc", datetime(2024, 1, 1)))
    schema = "id string, document_id string, page_no int, ordinal int, char_start int, char_end int, text string, embed_text string, created_at timestamp"
    twice = chunks + [c[:8] + (datetime(2024, 2, 1),) for c in chunks[::3]]
    df = spark.createDataFrame(twice, schema).selectExpr("*", "1 as lo", "'x' as kind")
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in texts.items()] * 2, "document_id string, page_no int, text string")
    got = {tuple(r) for r in split.broken_chunks(df, pages, range_size=range_size).collect()}
    assert got == broken(chunks, texts)
    assert split.broken_chunks(df.limit(0), pages).count() == 0
    nulls = spark.createDataFrame([("n:1:0", "n", 1, None, None, None, None, None, None)], schema)
    assert split.broken_chunks(nulls, pages).count() == 0


# --- problem 4 ---------------------------------------------------------------------------------------------


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(9999)}" for w in words]


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([35, 60, 150]))]
        for m in range(rng.choice([1, 2, 3])):
            texts[f"k{g}-{m}"] = edited(rng, base, rng.choice([0, 0.02, 0.08]))
    texts["short-a"] = texts["short-b"] = [f"s{i}" for i in range(29)]
    rows = [("page", k, "  ".join(w) + "\n") for k, w in texts.items()] + [("page", "null", None), ("page", "empty", ""), ("chunk", "k0-0", " ".join(texts["k0-0"]))]
    df = spark.createDataFrame(rows + rows[:5], "kind string, key string, text string")
    truth = {(a, b) for a in texts for b in texts if a < b and min(len(texts[a]), len(texts[b])) >= 30 and jaccard(texts[a], texts[b]) >= 0.4}
    got = {tuple(r) for r in neardup.edited_copies(df).collect()}
    assert got <= truth and len(truth - got) <= 0.03 * len(truth)
    clear = {p for p in truth if jaccard(texts[p[0]], texts[p[1]]) > 0.6}
    assert clear <= got


def test_many_exact_copies_stay_linear(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join([f"w{i}" for i in range(39)] + ["z"])
    df = spark.createDataFrame([("page", f"a{i:04d}", text) for i in range(3000)] + [("page", "b", other)], "kind string, key string, text string")
    out = neardup.copy_groups(df).collect()
    assert len(out) == 3001 and {r["class_key"] for r in out} == {"a0000", "b"} and all(r["links"] == 1 for r in out)
    assert neardup.copy_groups(df.limit(0)).count() == 0


def test_fingerprint_distance_follows_similarity():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(62) for _ in range(400)], "i8")
    b = np.array([rng.getrandbits(62) for _ in range(400)], "i8")
    _, bits = neardup.signatures([a, a.copy(), np.concatenate([a[:200], b[200:]]), b], 3)
    distance = lambda x, y: sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(x, y))
    assert distance(bits[0], bits[1]) == 0
    assert 40 < distance(bits[0], bits[2]) < neardup.RADIUS < distance(bits[0], bits[3])


# --- problem 6 ---------------------------------------------------------------------------------------------


def vectors(n, seed=2):
    rng = np.random.RandomState(seed)
    x = rng.randn(n, 32)
    near = rng.randint(0, n, n // 3)
    y = x[near] + 0.25 * rng.randn(len(near), 32)
    x = np.vstack([x, y, x[:5], x[:5]])
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4")


def test_mutual_neighbours_against_brute_force(spark):
    x = vectors(900)
    rows = [("f", i, f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [("f", 90001, "zero", [0.0] * 32), ("f", 90002, "null", None), ("f", 90003, "short", [1.0] * 31), ("g", 1, "nomodel", rows[0][3]), ("f", 90004, "hole", [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows + rows[:50], "vectors_path string, row_no int, chunk_id string, dense array<float>")
    files = spark.createDataFrame([("f", "m", 32), ("f", "m", 32), ("g", None, 32)], "vectors_path string, model string, dim int")
    good = knn.clean_vectors(df, files)
    assert good.count() == len(x)
    got = {(r["chunk_a"], r["chunk_b"]) for r in knn.mutual_neighbours(good).collect()}
    s = np.round(x.astype("f8") @ x.T.astype("f8"), 6)
    np.fill_diagonal(s, -2)
    near = [set(np.argsort(-row, kind="stable")[:5]) for row in s]
    truth = {(f"c{i:05d}", f"c{j:05d}") for i in range(len(x)) for j in near[i] if i < j and i in near[j] and s[i, j] >= 0.9}
    assert len(truth) > 100 and len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.01 * len(truth)
    assert knn.mutual_neighbours(good.limit(0)).count() == 0


def test_footrule():
    a = np.array([[1, 2, 3, 4]])
    assert knn.footrule(a, a)[0] == 0
    assert knn.footrule(a, np.array([[5, 6, 7, 8]]))[0] == 1
    assert 0 < knn.footrule(a, np.array([[2, 1, 3, 4]]))[0] < 0.2


# --- problem 8 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ours():
    return tokenizer.Encoder(tokenizer.default_path())


@pytest.fixture(scope="module")
def theirs():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(
    "text", ["", " ", "a \n\n b", "it's  we'll\t\tx", "<|endoftext|>", "\x1c x\x1d y", "a\x85 b　 c", "পুরনো নদীর ১২৩ গল্প।", "é 😀😀", "x" * 5000, "আক" * 3000, "\r\n  \r\n", "'s's 's", "    indent\n\tcode"])
def test_ids_equal_the_public_encoder(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_random_bytes_equal_the_public_encoder(ours, theirs):
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abcdeাকন ের\n '1২।é\t") for _ in range(rng.randrange(60)))
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_token_table(spark, ours):
    df = spark.createDataFrame([(1, "a river"), (2, ""), (3, None), (1, "a river")], "doc_id long, text string").selectExpr("*", "'x' as ids")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.token_ids(df).collect())
    assert got == [(1, ours.encode("a river")), (1, ours.encode("a river")), (2, []), (3, [])]
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def test_rank_queue_order():
    q = tokenizer.RankQueue()
    for rank, at in [(500, 3), (2, 9), (500, 1), (70000, 0), (2, 4)]:
        q.push(rank, at)
    assert [q.pop() for _ in range(6)] == [(2, 4), (2, 9), (500, 1), (500, 3), (70000, 0), None]


# --- problem 9 ---------------------------------------------------------------------------------------------


def test_fill_passes_shortages_on():
    assert mixing.fill(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert mixing.fill(100, [1, 1, 2], [10, 1000, 1000]) == pytest.approx([10, 30, 60])
    assert mixing.fill(100, [1, 0], [30, 1000]) == [30, 0]
    assert sum(mixing.fill(100, [1, 1], [20, 30])) == 50


def test_siblings_before_ancestors():
    leaf = lambda s, w, n, r=1: {"source": s, "language": "en", "weight": w, "repeats": r, "tokens": n}
    out = {x["source"]: x["whole"] * x["tokens"] + x["rest"] for x in mixing.plan([leaf("a x", 0.3, 100), leaf("a y", 0.2, 900), leaf("b x", 0.5, 900)], 1000)}
    assert out == {"a x": 100, "a y": 400, "b x": 500}


def test_mix(spark):
    rows = [(i, "river stone " * (1 + i % 7), ["Ash House", "ash house ", "Birch Barn", None][i % 4], ["en", "bn"][i % 2]) for i in range(400)] + [(900, None, "ash house", "en"), (901, "", "ash house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, language string").selectExpr("*", "1 as n_tokens", "2 as uses")
    targets = spark.createDataFrame([("ash house", 0.4, 2), ("BIRCH BARN", 0.6, 3), ("no docs", 0.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(docs.drop("n_tokens", "uses"), targets)
    got, shares = selection.collect(), {r["source"]: r for r in report.collect()}
    assert len({r["doc_id"] for r in got}) == len(got)
    assert all(r["uses"] <= {"ash house": 2, "birch barn": 3}[r["source"]] for r in got)
    assert shares["no docs"]["used_tokens"] == 0
    for s in ("ash house", "birch barn"):
        assert shares[s]["used_tokens"] == sum(r["n_tokens"] * r["uses"] for r in got if r["source"] == s)
        assert abs(shares[s]["actual_share"] - shares[s]["target_share"]) < 0.02
    again = sorted(map(tuple, mixing.mix(docs.drop("n_tokens", "uses"), targets)[0].collect()))
    assert again == sorted(map(tuple, got))
    none, empty = mixing.mix(docs.drop("n_tokens", "uses").limit(0), targets)
    assert none.count() == 0 and all(r["actual_share"] == 0 for r in empty.collect())


# --- problem 6, every vector's nearest ------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    x = vectors(500)
    df = spark.createDataFrame([(f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, v array<float>").selectExpr("'m' as model", "*")
    lone = spark.createDataFrame([("other", "z", [1.0, 0.0])], "model string, chunk_id string, v array<float>")
    rows = knn.nearest(df.unionByName(lone), share=1).collect()
    s = np.round(x.astype("f8") @ x.T.astype("f8"), 6)
    np.fill_diagonal(s, -2)
    near = [[f"c{j:05d}" for j in np.argsort(-row, kind="stable")[:5]] for row in s]
    got = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    assert "z" not in got and len(got) == len(x) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[f"c{i:05d}"]) & set(near[i])) / 5 for i in range(len(x))]) >= 0.9
    asked = {r["chunk_id"] for r in knn.nearest(df, share=7).collect()}
    assert 0 < len(asked) < len(x) and asked <= set(got)
    assert knn.nearest(df.limit(0)).count() == 0


def test_files_in_parts_give_the_same_pairs(spark):
    x = vectors(300)
    df = spark.createDataFrame([(f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, v array<float>").selectExpr("'m' as model", "*")
    _, index = knn.build_index(df)
    whole, parts = (sorted(map(tuple, knn.search(index, 5, 0.9, part=n).collect())) for n in (10_000, 7))
    assert len(whole) > 50 and whole == parts


def test_reranking_goes_on_while_it_finds():
    rng = np.random.RandomState(0)
    base = rng.randn(1, 16)
    x = knn.unit(base + 0.05 * rng.randn(200, 16))
    orders = np.array([rng.permutation(40)[:8] for _ in range(200)])
    ids = np.arange(200)
    a, b, cosine = knn.nearest_in_file(ids, orders, x, ids[:3], orders[:3], x[:3], 5, 0.5, 4)
    assert {n for n in np.bincount(a)} == {5} and min(cosine) > 0.9


# --- problem 3, boundaries and files ----------------------------------------------------------------------------


def test_no_word_is_cut_where_a_boundary_is_in_reach(spark):
    texts = {1: "x" * 695 + " " + "yyyyy. " + "word " * 200, 2: "x" * 340 + " " + "z" * 2000, 3: ("w" * 20 + " ") * 200}
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    out: dict = {}
    for r in split.split_texts(df, ["k"]).collect():
        out.setdefault(r["k"], []).append(r)
    for k, rows in out.items():
        check_chunks(texts[k], rows)
    assert {r["char_end"] for r in out[1] if r["ordinal"] == 0} == {695}
    assert {r["char_end"] for r in out[2] if r["ordinal"] == 0} == {340}
    for r in out[3]:
        assert texts[3][r["char_end"] : r["char_end"] + 1] in (" ", "")


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(12)
    texts = {"a": random_page(rng, 3000), "b": "নদী😀 é " * 900, "c": "short", "d": "", "e": "x" * 3000}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8", newline="")
    whole = spark.createDataFrame([(n, t) for n, t in texts.items() if t], "path string, text string")
    want = sorted(map(tuple, split.split_texts(whole, ["path"]).collect()))
    for size in (257, 5000, 1 << 20):
        got = sorted((r["path"].rsplit("/", 1)[1][:1], *r[1:]) for r in split.split_files(spark, str(tmp_path), range_bytes=size).collect())
        assert got == want


# --- problem 9, the tree ----------------------------------------------------------------------------------------


def test_sources_of_a_language_before_other_languages():
    leaf = lambda s, lang, w, n: {"source": s, "language": lang, "weight": w, "repeats": 1, "tokens": n}
    leaves = [leaf("a x", "en", 0.5, 100), leaf("a y", "en", 0.25, 900), leaf("a z", "bn", 0.25, 900)]
    out = {x["source"]: x["whole"] * x["tokens"] + x["rest"] for x in mixing.plan(leaves, 1000)}
    assert out == {"a x": 100, "a y": 650, "a z": 250}


def test_language_labels_in_any_spelling(spark):
    rows = [("হিন্দী",), ("हिन्दी",), ("Marathi",), ("মারাঠি",), ("bn_IN",), (" EN ",), ("fr",), ("",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(mixing.language_key(df.x)).collect()] == ["other", "hi", "mr", "other", "bn", "en", "other", "other", "other"]
