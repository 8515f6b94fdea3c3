import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import tokens as T

JSON = os.path.join(os.path.dirname(T.VOCABULARY), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def ranks():
    with open(T.VOCABULARY, "rb") as f:
        return T.read_ranks(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(text, ranks):
    import regex

    return [i for piece in regex.findall(T.PATTERN, text) for i in T.merge(piece.encode(), ranks)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_library(ranks, library, text):
    assert ids(text, ranks) == library(text)


@pytest.mark.parametrize("text", ["aaaaaaaaaa" * 300, "珍しいスキャナは肖像の川を支える" * 20, "don't we'll  x\n\n\ny <|endoftext|> 123456", "Ünïcödé 🇩🇪 е́", " \t\n ", "zzz" * 1000 + "ab" * 777])
def test_hard_texts(ranks, library, text):
    assert ids(text, ranks) == library(text)


def test_round_trip(ranks):
    names = {v: k for k, v in ranks.items()}
    text = "Any text, even ünïcödé 珍しい, comes back."
    assert b"".join(names[i] for i in ids(text, ranks)).decode() == text


def test_spark(spark, library):
    texts = ["hello world", None, "", " ", "hello world", "x" * 50_000]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, ids string, key string")
    got = {r["doc_id"]: r["ids"] for r in T.encode(df).collect()}
    assert got == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert T.encode(df.limit(0)).count() == 0
