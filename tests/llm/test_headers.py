import random

import pytest

from leafmill.llm import scans as S

PAGES = "page_id long, document_id long, source string, page int, text string, ocr_method string"


def rows(at):
    """(document, source, page, header, footer) as page rows with body lines of words of their own."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvwxyz") + rng.choice("aeiou") for _ in range(4))
    body = lambda: "\n".join(" ".join(word() for _ in range(6)) for _ in range(6))
    return [(1000 * d + p, d, source, p, "\n\n".join(filter(None, [head, body(), foot])), "t") for d, source, p, head, foot in at]


@pytest.fixture
def header(spark):
    words = spark.createDataFrame([("valley", "en", 5)], "word string, lang string, n_seen long")

    def run(at, files=(), author=False):
        schema = "document_id long, title string" + ", author string" * author
        pages = spark.createDataFrame(rows(at), PAGES)
        found = S.findings(pages, spark.createDataFrame(list(files), schema), words).where("kind = 'header'")
        return {(r["page_id"], r["line_no"]) for r in found.collect()}

    return run


def test_shared_wording_is_no_notice(header):
    chapter = "Introduction and general overview"
    at = [(d, "a", p, chapter, None) for d in (1, 2, 3) for p in (1, 2)]
    at += [(d, "a", 1, None, None) for d in range(10, 40)]
    # one third in common with three other documents doesn't bar a whole line
    at += [(50, "a", 1, "Old Northern Valley Of Rosalwick Mills Today", None)]
    at += [(51 + i, "a", 1, f"Old Northern Valley {x}", None) for i, x in enumerate(("speaks plainly here now", "with seven quiet rivers", "under grey morning clouds"))]
    got = header(at)
    assert {(1000 * d + p, 1) for d in (1, 2, 3) for p in (1, 2)} <= got and (50001, 1) in got


def test_notices_by_share_of_the_source(header):
    notice = "Please Share This Page With Your Friends"
    at = [(d, "a", p, None, notice) for d in range(1, 9) for p in (1, 2)] + [(9, "a", 1, None, None)]
    # in another source three documents of a hundred carry the same words as their chapter
    at += [(100 + d, "b", p, notice if d < 3 else None, None) for d in range(100) for p in (1, 2)]
    got = header(at)
    assert got == {(1000 * (100 + d) + p, 1) for d in range(3) for p in (1, 2)}


def test_short_headers(header):
    at = [(1, "a", p, "Mary Smith" if p % 2 else "Early maps 1" + str(p), None) for p in range(1, 5)]
    at += [(2, "a", p, None, "The Old Man") for p in (1, 2)]
    at += [(3, "a", p, "序章", None) for p in (1, 2)]
    at += [(4, "a", 1, "J. Kelurmond", None), (5, "a", 1, "Atlas", None), (6, "a", 1, "On a map", None)]
    # ends of sentences, a word at different ends, other documents' names and short lines on one page
    at += [(7, "a", p, None, "Register.") for p in (1, 2)] + [(8, "a", p, None, "終わる。") for p in (1, 2)]
    at += [(9, "a", 1, "Register", None), (9, "a", 2, None, "Register"), (10, "a", 1, "Atlas", None)]
    at += [(d, "a", 1, None, None) for d in range(20, 50)]
    files = [(4, "Some Title Of Northern Words", "J. Kelurmond"), (5, "Atlas", None), (6, "On a Map", None), (7, None, "Mary Smith")]
    got = header(at, files, author=True)
    assert got == {(1001, 1), (1002, 1), (1003, 1), (1004, 1), (2001, 8), (2002, 8), (3001, 1), (3002, 1), (4001, 1), (5001, 1), (6001, 1)}
