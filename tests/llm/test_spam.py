import random

from leafmill.llm import spam as S

FUNCTION = "the of and a in that it was for on".split()


def prose(rng, n):
    words = [a + b + c for a in "bdfgklmn" for b in ("ara", "eli", "ono", "uma") for c in ("ste", "rin", "lok")]
    out = []
    for _ in range(n):
        out.append(" ".join([rng.choice(FUNCTION) if i % 3 == 0 else rng.choice(words) for i in range(rng.randrange(9, 14))]).capitalize() + ".")
    return " ".join(out)


def test_kinds(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 8), "en" if i % 10 else None) for i in range(80)]
    links = "\n".join(f"- [{'abc'[i % 3]} the thing {i}](https://h{i}.example/x)" for i in range(12))
    few = prose(rng, 6) + "\n" + "\n".join(f"[{i}] https://h{i}.example/a/long/address/that/counts" for i in range(3))
    spam = {
        900: "cheap toner best toner " * 30,
        901: links,
        902: " ".join(f"#{a}{b}" for a in ("buy", "best", "cheap") for b in ("Toner", "Paper", "Ink", "Label", "Binder", "Folder", "Ribbon")),
        903: " · ".join(f"word{c} Name{c}" for c in "abcdefghijklmnopqrstuvwxyz"),
        904: prose(rng, 1) + "\n" + "\n".join(f"{a} stapler" for a in ("red", "blue") * 40),
        905: prose(rng, 1) + "\n" + "If you want the best stapler of it, choose the best stapler: that best stapler was a best stapler. " * 8,
    }
    fine = {
        800: few,
        801: "\n".join(f"AB-{i} | folder | A4 | {i}.50 EUR | best" for i in range(30)),
        802: '{"a": 1, "b": [1, 2], "c": "xyz", "dd": null, "ee": true, "ff": 0.25, "gg": "q", "h": 3}\n' * 4,
        803: prose(rng, 5) + "\n#one #two #three #four #five #six",
        804: "best toner " * 5,
        805: None,
        806: "",
        807: " \n" * 300,
        808: prose(rng, 400),
    }
    rows += [(k, t, "en") for k, t in (spam | fine).items()]
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], "doc_id long, text string, lang string, fs string, chars string")
    got = {r["doc_id"] for r in S.spam_pages(df).collect()}
    assert got == set(spam)
    words = S.function_words(df)
    assert set(words) == {"en"} and words["en"] <= set(FUNCTION)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.spam_pages(df).count() == 0
