import random
import re

from leafmill.operators import resolve
from leafmill.plans import resolution

PAGES, STRIPS = "document_id long, page int, text string", "document_id long, page int, narrow string, dominant string"


def judged(df):
    return {(r["document_id"], r["page"]): (r["text"], r["decision"], r["matched"], r["fragments"], r["ratio"]) for r in df.collect()}


def plainly(pages, strips):
    """Page after page, as the rule is written."""
    now, out = {(d, p): t or "" for d, p, t in pages}, {}
    nominated = {(d, p): (narrow or "", dominant or "") for d, p, narrow, dominant in strips}
    for d, p in sorted(now):
        if (d, p) in nominated:
            narrow, dominant = nominated[d, p]
            matched, fragments = resolve.overlap(narrow, now.get((d, p - 1), "") + "\n" + now.get((d, p + 1), ""))
            ratio = matched / fragments if fragments else 0.0
            sure = matched >= 8 and ratio >= 0.8
            now[d, p] = dominant if sure else now[d, p]
            out[d, p] = (now[d, p], "confirmed_excluded" if sure else "ambiguous_retained", matched, fragments, round(ratio, 3))
        else:
            out[d, p] = (now[d, p], None, None, None, None)
    return out


def test_as_page_after_page(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("stra", "of", "Wörter", "rain") for b in ("e", "'s-", "ing", "ſt") for c in ("n", "ow", "ledge", "ß")]
    some = lambda n: " ".join(r.choices(words, k=n)) + r.choice(("", ".", "\n"))
    pages, strips = [], []
    for d in range(60):
        for p in range(1, r.randint(2, 25)):
            strip, own = some(r.choice((3, 12, 30, 90))), some(r.choice((0, 5, 40)))
            if r.random() < 0.9:
                pages.append((d, p, r.choice((strip + own, own, some(60), strip, None))))
            if r.random() < 0.8:
                strips.append((d, p, r.choice((strip, strip, strip, some(20), None)), r.choice((own, own, strip, some(50), None))))
    want = plainly(pages, strips)
    assert judged(resolve.resolve_runovers(spark.createDataFrame(pages, PAGES), spark.createDataFrame(strips, STRIPS))) == want
    decided = [want[k][1] for k in want]
    assert min(decided.count(x) for x in (None, "confirmed_excluded", "ambiguous_retained")) > 20


def test_a_long_strip_needs_several_numbers(spark):
    long = [f"{a}{b}{c}word" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    pages, strips = [(1, 1, " ".join(long[:130])), (1, 2, "x"), (1, 3, " ".join(long[120:]))], [(1, 2, " ".join(long), "y")]
    assert judged(resolve.resolve_runovers(spark.createDataFrame(pages, PAGES), spark.createDataFrame(strips, STRIPS)))[1, 2] == ("y", "confirmed_excluded", 216, 216, 1.0)


def test_a_page_that_is_missing_ends_a_row(spark):
    strip = " ".join(f"{a}{b}word" for a in "abc" for b in "defg")
    pages = spark.createDataFrame([(1, 1, strip), (1, 3, "own " + strip), (None, 1, strip), (1, None, "x")], PAGES)
    strips = spark.createDataFrame([(1, 1, "few words", "y"), (1, 2, strip, "nowhere"), (1, 3, strip, "own"), (None, 1, strip, "z")], STRIPS)
    got = judged(resolve.resolve_runovers(pages, strips))
    # page 1 isn't the page before page 3, whether or not page 2 was nominated
    assert got[1, 3] == ("own " + strip, "ambiguous_retained", 0, 12, 0.0)
    assert got[None, 1] == (strip, None, None, None, None) and got[1, None] == ("x", None, None, None, None) and len(got) == 4


def test_texts_are_shuffled_once_and_no_group_goes_to_python(spark, data):
    df = resolution.runover_pages(spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FlatMapGroups" not in plan
    # the pages themselves and the beginnings of those after
    assert len(re.findall(r"FileScan parquet \[[^\]]*text#", plan)) == 2
