"""Every operator gives the same rows whichever way its joins go, and beyond each bound on what is shipped."""

import random
from hashlib import md5

import pytest

from conftest import rows
from leafmill import session
from leafmill.llm import leaks, lines, queries, scans, spam
from leafmill.session import read, tidy, written_tables
from test_spam import prose


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_pieces", "p5_found", "p8_found"])
def test_without_broadcasts(spark, data, name, monkeypatch):
    before = written_tables(spark)
    with tidy(spark):
        want = rows(queries.queries()[name](spark, data).toPandas())
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
        assert rows(queries.queries()[name](spark, data).toPandas()) == want and want
    assert written_tables(spark) == before


def test_lexicon_that_is_not_shipped(spark, data, monkeypatch):
    want = rows(queries.p2_text(spark, data).toPandas())
    monkeypatch.setattr(scans, "MOST_LEXICON_BYTES", 0)
    assert rows(queries.p2_text(spark, data).toPandas()) == want


def test_test_items_in_several_sets_and_small_shards(spark, data, monkeypatch):
    want = rows(queries.p7_spans(spark, data).toPandas())
    monkeypatch.setattr(leaks, "MOST_TEST_BYTES", 40_000)
    monkeypatch.setattr(leaks, "SHARD_BYTES", 10)
    assert rows(queries.p7_spans(spark, data).toPandas()) == want and want


def test_words_of_any_length(spark):
    long = "zusammen" * 300
    known = spark.createDataFrame([(long, 1, 5), ("モデル", 1, 5)], "word string, listed int, n long").withColumn("hash", scans.anagram_column(scans.F.col("word")))
    assert {r["word"]: r["hash"] for r in known.collect()} == {w: scans.anagram(w) for w in (long, "モデル")}
    seen = long.replace("m", "rn", 1)
    got = scans.corrections(spark.createDataFrame([(seen,)], "word string"), known).collect()
    assert [(r["word"], r["best"]) for r in got] == [(seen, long)]


def test_three_unseen_languages_are_no_spam(spark):
    rng = random.Random(9)

    def made(letters, small, n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(400)]
        return " ".join(rng.choice(small) if i % 3 == 0 else rng.choice(words) for i in range(n))

    base = [(i, prose(rng, 8), "en") for i in range(80)]
    tongues = {"ko": ("가나다라마바사아자차", ("은", "는", "이", "가")), "pl": ("abcdezwykłąśó", ("i", "w", "na", "się")), "el": ("αβγδεζηθικλ", ("και", "το", "να", "της"))}
    rare = []
    for k, (code, (letters, few)) in enumerate(tongues.items()):
        rare += [(1000 * (k + 1) + i, made(letters, few, 90), code if i % 4 else None) for i in range((1, 8, 19)[k])]
    spam_rows = [(5000, "kup papier tani papier " * 30, "pl"), (5001, "best toner cheap toner " * 30, None)]
    df = spark.createDataFrame(base + rare + spam_rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == {5000, 5001}


def test_the_ratio_rejects_lines_that_are_as_common_elsewhere(spark):
    common, notice = "this line is as common in every single place", "only this source prints this very notice"
    table = []
    for s in range(8):
        for doc in range(60):
            text = f"body {s} {doc} " + "".join(chr(97 + int(c, 16)) for c in md5(f"{s} {doc}".encode()).hexdigest())
            text += f"\n{common}" if doc % 30 == 0 else ""
            text += f"\n{notice}" if s == 0 and doc < 6 else ""
            table.append((s * 1000 + doc, s * 1000 + doc, f"s{s}", text))
    df = spark.createDataFrame(table, "page_id long, document_id long, source string, text string")
    assert tuple(lines.test_counts(df).first()) == (9, 8, 0, 1)
    assert {r["page_id"] for r in lines.repeated_lines(df).collect()} == set(range(6))


def test_counts_at_hand(spark, data):
    r = lines.test_counts(read(spark, data, "pdf_pages")).first()
    assert r["tested"] == r["no_excess"] + r["below_minima"] + r["found"] and r["found"] > 0
