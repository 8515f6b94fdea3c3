import math

from leafmill.llm import lines as L

SCHEMA = "source string, document_id long, page_id long, text string, line_hash string, k string"
NOTICE = "This notice stands on every page of the site 12"


def brute(rows):
    """The definition, directly."""
    key = lambda x: "".join(c for c in x.upper().lower() if not c.isspace() and not c.isdecimal())
    docs, seen = {}, {}
    for src, doc, page, text in rows:
        docs.setdefault(src, set()).add(doc)
        for line in (text or "").split("\n"):
            if sum(map(str.isalpha, key(line))) >= 20:
                seen.setdefault((src, key(line)), set()).add(doc)
    hot = {k for k, d in seen.items() if len(d) >= 3 and len(d) >= 0.05 * len(docs[k[0]])}
    return {(page, i) for src, _, page, text in rows for i, line in enumerate((text or "").split("\n"), 1) if (src, key(line)) in hot}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def pages():
    rows = []
    for d in range(30):
        body = f"Page of document number {chr(97 + d % 26) * 12} with its own words\n"
        rows.append(("a", d, 100 + d, body + ("THIS NOTICE stands on every page of the site 9\t" if d % 3 == 0 else "plain") + "\n\nshort"))
    rows += [("b", 50 + d, 500 + d, f"{NOTICE}\r\nother text here number {'xyz'[d] * 20}") for d in range(3)]
    rows += [(None, 70 + d, 700 + d, NOTICE) for d in range(4)]
    rows += [("c", 90, 900 + i, NOTICE) for i in range(5)]  # one document only
    rows += [("d", 95, 950, None), ("d", 96, 951, ""), ("d", 97, 952, "\n" * 50), ("d", 98, 953, "lorem ipsum dolor sit amet " * 5000)]
    rows += [("e", 200 + d, 2000 + d, f"Words of another site {chr(97 + d % 26) * (20 + d)}") for d in range(60)]
    return rows + rows[:7]


def test_found_equals_definition(spark):
    rows = pages()
    got = [tuple(r) for r in L.repeated_lines(frame(spark, rows)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and len(got) == 17


def test_text_without_them(spark):
    rows = pages()
    hit = brute(rows)
    got = {r["page_id"]: r["text"] for r in L.strip_repeated_lines(frame(spark, rows)).collect()}
    want = {p: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (p, i) not in hit) for _, _, p, t in rows}
    assert got == want


def test_empty(spark):
    assert L.repeated_lines(frame(spark, [])).count() == 0
    assert L.strip_repeated_lines(frame(spark, [])).count() == 0


def test_threshold():
    strong = {80: 5}
    assert L._threshold(strong, 0.05) == 20.0
    assert math.isinf(L._threshold({0: 10}, 0.05)) and math.isinf(L._threshold({}, 0.05))
