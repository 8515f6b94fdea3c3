import pytest

from leafmill.llm import scans as S

PAGES = "page_id long, document_id long, page int, text string, ocr_method string, word string, line string"
WORDS = "the furnace editor other another valley museum hand-written paragraph legal memory agricultural north modern".split()


@pytest.fixture(scope="module")
def found(spark):
    title = "Rural Valley Of North"
    p = [
        (1, 1, 1, "RURAL VALLEY OF NORTH\nthe fiimace | another eclitor\nlegal agri-\n12", "t"),
        (2, 1, 2, "RURAL VALLEY OF N0RTH\ncultural museum hand-\nwritten memory\n_\nthe val-\n\nley modem para¬\n13", "t"),
        (3, 1, 3, "l4\ngraph the other\n1876\nmuseum.", "t"),
        (3, 1, 3, "l4\ngraph the other\n1876\nmuseum.", "t"),
        (4, 2, 1, "the valley", ""),
        (5, 2, 2, "fiimace", None),
        (6, 3, 1, None, "t"),
        (7, 3, 2, "", "t"),
        (8, 3, 3, " \n\n", "t"),
        (9, 4, 1, "the other\nmuseum in 1876.", "t"),
        (10, 5, 1, "another " * 20_000, "t"),
    ]
    pages = spark.createDataFrame([(*x, "w", "l") for x in p], PAGES)
    files = spark.createDataFrame([(1, title), (1, title), (2, None)], "document_id long, title string")
    lexicon = spark.createDataFrame([(w, "en", 5) for w in WORDS] + [(None, None, None)], "word string, lang string, n_seen long")
    return pages, files, lexicon


def test_found(spark, found):
    got = sorted((r["page_id"], r["line_no"], r["kind"]) for r in S.findings(*found).select("page_id", "line_no", "kind").distinct().collect())
    assert got == [
        (1, 1, "header"), (1, 2, "mark"), (1, 2, "misread"), (1, 3, "hyphen"), (1, 4, "page_number"),
        (2, 1, "header"), (2, 4, "mark"), (2, 5, "hyphen"), (2, 7, "hyphen"), (2, 7, "misread"), (2, 8, "page_number"),
        (3, 1, "page_number"),
    ]


def test_repair(spark, found):
    got = {r["page_id"]: r["text"] for r in S.repaired(*found).collect()}
    assert got[1] == "the furnace another editor legal agricultural"
    assert got[2] == "museum hand-written memory the valley modern paragraph"
    assert got[3].startswith("the other 1876 museum.")
    assert set(got) == {1, 2, 3, 8, 9, 10} and got[8] == ""


def test_empty(spark, found):
    pages, files, lexicon = found
    assert S.findings(pages.limit(0), files, lexicon).count() == 0
    assert S.findings(pages, files.limit(0), lexicon.limit(0)).where("kind = 'misread'").count() == 0


def test_explain():
    assert S.explain("fiimace", "furnace") == 2 and S.explain("tbeir", "their") == 1 and S.explain("xbc", "abc") == S.DEPTH + 1
    assert S.explain("same", "same") == 0


@pytest.mark.parametrize(("line", "value"), [("12", 12), (" - l2O - ", 120), ("Seite 7", 7), ("[l39]", 139), ("clxvii", 167), ("5O", 50), ("15.", 15), ("— 9 —", 9), ("the end", None), ("12 kg", None), ("H266", None), ("", None), ("did", None)])
def test_printed_number(line, value):
    got = S.printed_number(line)
    assert (got and got[0]) == value
