import random

from leafmill.llm import spam as S
from test_spam import prose


def foreign(rng, n):
    words = [a + b + c for a in "prstvwz" for b in ("ilu", "oka", "ute") for c in ("nde", "mik", "rof")]
    return " ".join(rng.choice(("ja", "ei", "se", "on", "ne")) if i % 3 == 0 else rng.choice(words) for i in range(n))


def judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"] for r in S.spam_pages(df).collect()}


def test_rare_languages_are_no_spam(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 8), "en") for i in range(40)]
    rare = [(100 + i, foreign(rng, 90), "fi") for i in range(5)]
    spam = [(900, "halpa kynä paras kynä " * 30, "fi"), (901, " · ".join(f"sana{c} nimi{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "fi"), (902, " ".join(f"toner{a}{b}" for a in "abcdefgh" for b in "abcdefgh"), "en")]
    assert judged(spark, rows + rare + spam) == {900, 901, 902}
    # no language at all has enough documents
    assert judged(spark, rows[:15] + rare + spam[:2]) == {900, 901}
    assert judged(spark, [(i, foreign(rng, 90), None) for i in range(5)]) == set()
