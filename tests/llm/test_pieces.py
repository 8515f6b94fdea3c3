from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import pieces as P

PAGES = "document_id long, page_id long, text string, limit string, sizes string"
REQUESTS = "request_id long, document_id long, segment_mode string, target_passage_length int, anythingllm_chunk_overlap_override int, page_id string"
POLICY = "mode string, target_drift_fraction double"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;\n\r。é́", max_size=300), st.integers(1, 60), st.integers(-3, 70))
def test_cut_invariants(text, limit, overlap):
    got = P.cut(text, limit, overlap)
    keep = max(0, min(overlap, limit - 1)) if len(text) > limit else 0
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    assert all(y[0] == x[1] - keep and y[1] > x[1] for x, y in zip(got, got[1:]))


def test_natural_boundaries_come_first():
    text = "One two three four. Five six seven eight. Nine ten eleven twelve. " * 3
    got = P.cut(text, 100, 10)
    assert all(P.KINDS[k] == "sentence" for _, _, k in got[:-1])
    assert P.cut("x" * 100, 30, 0) == [(0, 25, 0), (25, 50, 0), (50, 75, 0), (75, 100, 0)]
    marks = "é" * 40
    assert all(marks[b : b + 1] != "́" for _, b, _ in P.cut(marks, 21, 0)[:-1])


def test_requests_and_pages(spark):
    long = "A sentence of some words stands here. " * 30
    pages = spark.createDataFrame([(1, 10, long, "x", "y"), (1, 10, long, "x", "y"), (1, 11, "short", "", ""), (1, 12, None, "", ""), (2, 20, long[:125], "", ""), (3, 30, "", "", "")], PAGES)
    policy = spark.createDataFrame([("page", 0.25), ("none", 0.0), ("loose", None)], POLICY)
    req = spark.createDataFrame(
        [
            (1, 1, " Page ", 100, 20, ""), (1, 1, " Page ", 100, 20, ""), (2, 1, "PAGE", 100, None, ""), (3, 1, "none", 10, 0, ""), (4, 9, "page", 10, 0, ""), (5, 2, "page", 100, 0, ""), (6, 2, "loose", 100, 500, ""),
            (7, 1, None, 10, 0, ""), (8, 1, "page", None, 0, ""), (9, 1, "page", 0, 0, ""), (10, 1, "odd", 10, 0, ""),
        ],
        REQUESTS,
    )
    got = P.request_pieces(pages, req, policy).collect()
    by = {}
    for r in got:
        by.setdefault((r["request_id"], r["page_id"]), []).append((r["piece"], r["start"], r["stop"], r["text"]))
    assert set(by) == {(1, 10), (2, 10), (6, 20)}
    for (request, page), p in by.items():
        p.sort()
        text = long if page == 10 else long[:125]
        assert [x[0] for x in p] == list(range(len(p))) and all(text[a:b] == t and len(t) <= 125 for _, a, b, t in p)
        keep = {1: 20, 2: 0, 6: 99}[request]
        assert all(y[1] == x[2] - keep for x, y in zip(p, p[1:]))
    assert P.request_pieces(pages.limit(0), req, policy).count() == 0
    assert P.request_pieces(pages, req.limit(0), policy, with_text=False).count() == 0
