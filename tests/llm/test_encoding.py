from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import encoding as E

CLEAN = ["", "plain words only", "প্রাচীন নদীর তীরে গ্রাম।", "São naïve Übung crème brûlée £40 10 °C ½ “river” it’s", "उज्ज्वल रास्ता गाँव", "wheel bef¬\nore", "¤_# _ +$&¤ §", "ক​খ"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert E.restore(text) == (text, 0, False)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp1254", "koi8_r", "iso8859_5"])
@pytest.mark.parametrize("layers", [1, 2])
def test_round_trip(wrong, layers):
    text = garbled = "কঠিন résumé naïve — ‘lamp’ प्रदीप"
    for _ in range(layers):
        garbled = E._decode(garbled.encode(), wrong, "keep")
    fixed, spans, lost = E.restore(garbled)
    assert (fixed, lost) == (text, False) and spans > 0


def test_only_spans_are_replaced():
    good = "সবুজ নদী এবং "
    bad = E._decode("মধুর গান".encode(), "cp1252", "keep")
    assert E.restore(good + bad + " আলো")[0] == good + "মধুর গান আলো"


def test_single_byte_pair():
    assert E.restore("rйsumй and cafй")[0] == "résumé and café"
    assert E.restore("Привет мир")[1] == 0  # Cyrillic words are no case


def test_lost_bytes_are_found_but_kept():
    dropped = E._decode("দূরে".encode(), "cp1252", "drop").replace("§‚", "§")
    text, spans, lost = E.restore(dropped)
    assert spans > 0
    assert E.restore("জী��নকে") == ("জী��নকে", 1, True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x0980, max_codepoint=0x09FF) | st.sampled_from("abc .,\n"), max_size=60))
def test_any_indic_text_comes_back(text):
    assert E.restore(E._decode(text.encode(), "cp1252", "keep"))[0] == text


def test_operator(spark):
    bad = E._decode("নদী".encode(), "cp1252", "keep")
    quality = json.dumps({"samples": [bad]}, ensure_ascii=False)
    escaped = json.dumps({"samples": [bad]})
    rows = [("a", 1, bad, None), ("a", 1, bad, None), ("b", 1, "ok", quality), ("c", 1, None, escaped[:-3]), ("d", 1, "", "{}"), (None, None, bad, "")]
    df = spark.createDataFrame(rows, "document_id string, page_no int, raw_text string, quality string").selectExpr("*", "1 as n_spans", "'x' as field")
    got = {(r["document_id"], r["field"], r["repairable"]) for r in E.repair_encoding(df).collect()}
    assert got == {("a", "raw_text", True), ("b", "quality", True), ("c", "quality", True), (None, "raw_text", True)}
    assert E.repair_encoding(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "শব্দ " * 200_000 + E._decode("নদী".encode(), "cp1252", "keep")
    df = spark.createDataFrame([("a", 1, text, None)], "document_id string, page_no int, raw_text string, quality string")
    assert E.repair_encoding(df).collect()[0]["repaired"].endswith("নদী")


#: A sentence in each of several scripts.
SCRIPTS = {
    "bengali": "নদীর তীরে গ্রাম", "devanagari": "नदी के किनारे गाँव", "tamil": "ஆற்றின் கரையில் ஊர்", "thai": "หมู่บ้านริมแม่น้ำ", "greek": "Το χωριό δίπλα στο ποτάμι", "russian": "Деревня у реки",
    "hebrew": "הכפר ליד הנהר", "arabic": "القرية بجانب النهر", "japanese": "川のほとりの村です 日本語", "chinese": "河边的村庄很安静", "korean": "강가의 마을은 조용하다", "georgian": "სოფელი მდინარესთან",
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp437", "koi8_r"])
def test_any_script_comes_back_or_stays(script, wrong):
    text = SCRIPTS[script]
    assert E.restore("ok " + text)[0] == "ok " + text  # right text is left alone
    garbled = E._decode(text.encode(), wrong, "keep")
    fixed, spans, lost = E.restore("see " + garbled + " end")
    assert spans > 0
    if script not in ("russian",):  # its letters are garbled forms themselves
        assert fixed == f"see {text} end" or lost
    dropped = "see " + E._decode(text.encode(), "cp1252", "drop") + " end"
    fixed, spans, lost = E.restore(dropped)
    if lost and script in ("japanese", "chinese", "korean"):
        assert all(run in fixed for run in dropped.split()) or "�" not in fixed


@pytest.mark.parametrize("layers", [5, 6])
def test_many_layers(layers):
    text = garbled = "নদী résumé"
    for _ in range(layers):
        garbled = E._decode(garbled.encode(), "latin-1", "keep")
    assert E.restore(garbled)[0] == text


def test_single_bytes_beside_cyrillic_words():
    assert E.restore("cafй and привет")[0] == "café and привет"
    assert E.restore("привет в дом")[1] == 0


def test_json_is_untouched_outside_the_spans():
    bad = json.dumps(E._decode("নদী".encode(), "cp1252", "keep"))[1:-1]
    value = '{"a": 12.0, "a": 1e-3, "b": "\\u0041\\n\\"x\\" ' + bad + ' \\ud83d\\ude00", "c":  [1 ,2]'
    fixed, spans, lost = E.restore_json(value)
    assert spans > 0 and not lost and fixed == value.replace(bad, "নদী")
    assert E.restore_json('{"t": "\\u0041"}') == ('{"t": "\\u0041"}', 0, False)
    assert E.restore_json('{"t": "\\ud800 \\u00') == ('{"t": "\\ud800 \\u00', 0, False)
