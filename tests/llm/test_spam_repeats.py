import random

from leafmill.llm import spam as S
from test_spam import prose

SENTENCE = "The quiet harbour of mills and a bright lantern for orchards in that valley was a gentle meadow on painted bridges with silver copper amber walnut cedar ribbons. "


def test_repeated_sentences_and_lines(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 8), "en") for i in range(60)]
    stamped = "\n".join(f"2026-01-01 10:{i:02} {SENTENCE}" for i in range(40))
    spam = {900: SENTENCE * 200, 901: (SENTENCE + "\n") * 12, 902: prose(rng, 2) + "\n" + "\n".join(f"{SENTENCE}{rng.random()}" for _ in range(9))}
    fine = {800: prose(rng, 30) + "\n" + SENTENCE * 3, 801: SENTENCE * 2, 802: stamped}
    df = spark.createDataFrame(rows + [(k, t, "en") for k, t in (spam | fine).items()], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in S.spam_pages(df).collect()} == set(spam)
