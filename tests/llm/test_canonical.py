import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import canonical as C

SAME = [
    ("ｆｕｌｌ ｗｉｄｔｈ", "full width"), ("ofﬁce", "office"), ("café", "café"), ("zero​width", "zerowidth"), ("a b", "a b"), ("a\r\nb", "a\nb"), ("аpple", "apple"), ("sοn", "son"),
    ("тиxий", "тихий"), ("well‑known", "well-known"), ("が", "が"), ("so­ft", "soft"), ("Å", "Å"), ("10 µm", "10 μm"), ("a  b", "a b"), ("ｶﾞ", "ガ"), ("Сорley", "Copley".replace("p", "р")), ("﻿x", "x"),
]
DIFFERENT = [("Case", "case"), ("resume", "résumé"), ("m²", "m2"), ("1", "l"), ("O", "0"), ("a b", "ab"), ("é", "e"), ("é", "è"), ("a—b", "a-b"), ("a b c", "a bc")]


def test_pairs():
    for a, b in SAME:
        assert C.look(a) == C.look(b), (a, b)
    for a, b in DIFFERENT:
        assert C.look(a) != C.look(b), (a, b)


def test_russian_stays_russian():
    assert C.canonical("Этoт сон и a") == "Этот сон и а"
    assert C.canonical("Сова is here, a word; is") == "Сова is here, a word; is"
    assert C.canonical("рaper") == "paper"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab eéе́о́​ \r\nｆﬁ가ᅡㄱが-‐Σο²", max_size=40))
def test_stable_and_normal(text):
    once = C.canonical(text)
    assert C.canonical(once) == once
    assert unicodedata.normalize("NFC", once) == once
    assert not any(c in once for c in "​ \rｆﬁ‐")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    once = C.canonical(text)
    assert C.canonical(once) == once


def test_pairs_in_spark(spark):
    rows = [(1, "one café"), (2, "one café"), (3, "one café"), (4, "ONE café"), (5, None), (6, ""), (7, " ​\n"), (8, " "), (9, "x" * 200_000), (10, "x" * 200_000 + "​"), (1, "one café"), (None, "one café")]
    df = spark.createDataFrame([(a, b, "z", "z", "z") for a, b in rows], "page_id long, text string, look string, own string, key string")
    got = sorted(tuple(r) for r in C.same_look_pairs(C.look_keys(df)).collect())
    assert got == [(1, 2), (2, 3), (9, 10)]
    text = {r["page_id"]: r["text"] for r in C.canonical_text(df.where("page_id is not null")).collect()}
    assert text[2] == "one café" and text[5] is None and text[6] == ""
    assert C.same_look_pairs(C.look_keys(df.limit(0))).count() == 0


def test_classes_and_other_scripts(spark):
    from leafmill.llm import canonical as C

    assert C.canonical("hօme ոew") == "home new" and C.canonical("ᎪᎢM") == "ATM" and C.canonical("ɑlɡa") == "alga"
    armenian = "Հայերեն լեզու օր"
    assert C.canonical(armenian) == armenian
    texts = [(1, "café"), (2, "café"), (3, "café"), (4, "tea"), (5, "tea"), (6, None), (7, "cаfé")]
    keys = C.look_keys(spark.createDataFrame(texts, "page_id long, text string"))
    got = {r["page_id"]: (r["representative"], r["texts"]) for r in C.look_classes(keys).collect()}
    assert got == {1: (1, 3), 2: (2, 3), 3: (1, 3), 7: (7, 3)}
    pairs = {tuple(r) for r in C.same_look_pairs(keys).collect()}
    assert pairs == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
