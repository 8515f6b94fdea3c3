from pyspark.sql import functions as F

from leafmill.operators import evidence as E
from leafmill.operators import match as M


def test_status_classes(spark):
    df = spark.createDataFrame([(s,) for s in ("pass", "review", "blocked", "odd", "concurrent_write_ambiguous")], "s string")
    assert [r[0] for r in df.select(E.status_class(F.col("s"))).collect()] == ["pass", "review", "error", "incomplete", "review"]
    assert df.select(E.status_class(F.col("s"), True)).collect()[4][0] == "incomplete"


def test_reconcile_and_missing(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    got = {r["id"]: r["stage"] for r in E.reconcile({"prepared": k(1, 2, 3, 1), "stored": k(2, 3, 4), "confirmed": k(3)}, "id").collect()}
    assert got == {1: "prepared", 2: "stored", 3: "confirmed", 4: "out_of_order"}
    assert [r[0] for r in E.missing(k(1, 2, 2), k(2), ["id"]).collect()] == [1]


def test_count_check(spark):
    df = spark.createDataFrame([(3, 3, 0, 4), (3, 3, None, None), (0, 0, 1, 1), (3, 2, 5, 5)], "p int, e int, a int, b int")
    assert [r[0] for r in df.select(E.count_check(F.col("p"), F.col("e"), F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_poll_deadlines(spark):
    o = lambda *s: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(s)], "run int, attempt int, status string")
    run = lambda df, **k: tuple(E.first_verdict(df, "run", **k).first())
    assert run(o("incomplete", "incomplete", "pass"), timeout=25, interval=10, cap=12) == (1, 3, 12.0, "pass")
    assert run(o(*["incomplete"] * 9), timeout=25, interval=10, cap=12) == (1, 3, 12.0, "timeout")
    assert run(o(*["incomplete"] * 9), timeout=5, interval=2, cap=90)[1] == 4
    assert run(o("incomplete", "pass"), timeout=0, interval=2, cap=90) == (1, 1, 0.0, "timeout")
    assert run(o("error", "pass"), timeout=9, interval=2, cap=90)[3] == "error"


def test_owned_events_and_guard(spark):
    e = spark.createDataFrame([(1, 0, "all_complete", None), (1, 1, "doc_complete", "a\\b"), (1, 2, "doc_complete", "x/y"), (1, 3, "all_complete", None)], "run int, seq int, type string, location string")
    owned = spark.createDataFrame([("a/b",)], "location string")
    assert [r["seq"] for r in E.owned_events(e, owned, "run").orderBy("seq").collect()] == [1, 3]
    g = spark.createDataFrame([(1, True, False), (2, False, False), (2, False, True), (3, False, True)], "run int, foreign boolean, connected boolean")
    assert {r["run"]: r["guard"] for r in E.queue_guard(g, ["run"]).collect()} == {1: "active", 2: "uncertain", 3: "idle"}


def test_ordered_distinct_and_privacy(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0)], "g int, v string, o int")
    assert E.ordered_distinct(df, "g", "v", "o").first()["items"] == ["b", "a"]
    p = spark.createDataFrame([(1, '{"source_path": "x"}'), (2, "C:\\a\\b"), (3, "f" * 64), (4, "sk-abcdefgh12"), (5, "fine"), (6, None)], "id int, t string")
    assert {r["id"]: r["findings"] for r in E.privacy_findings(p, "id", F.col("t")).collect()} == {1: ["forbidden_key"], 2: ["windows_path"], 3: ["sha256"], 4: ["api_key"]}


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "[a | PDF_PAGE 3]\nDie Straße liegt\nhier")], "document_id int, text string")
    req = spark.createDataFrame([(9, 1, "STRASSE"), (9, 1, ""), (9, 1, "fehlt"), (9, 1, None), (8, 2, "x"), (9, 1, "STRASSE")], "request_id int, document_id int, phrase string")
    got = {(r["request_id"], r["phrase"]): (r["status"], r["position"], r["marker"]) for r in M.phrase_validation(req, docs).collect()}
    assert got == {(9, "STRASSE"): ("found", 21, "[a | PDF_PAGE 3]"), (9, ""): ("found", 0, ""), (9, "fehlt"): ("missing", -1, ""), (8, "x"): ("missing", -1, "")}


def test_fragments(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india"
    df = spark.createDataFrame([(1, 1, words), (1, 2, words.replace("alpha", "alphabet")), (1, 4, words), (2, 1, None)], "document_id int, page int, text string")
    got = {(r["document_id"], r["page"]): r for r in M.fragment_match(df).collect()}
    assert got[1, 1]["fragments"] == 9 and got[1, 1]["matched"] == 7  # echo and golf aren't the start of a word of six letters
    assert got[1, 4]["matched"] == 0 and not got[2, 1]["confirmed"] and got[2, 1]["fragments"] == 0


def test_reuse_hints_layers(spark):
    s = spark.createDataFrame([(5, "t", None), (3, "t", None), (4, "u", "x")], "k int, a string, b string")
    w = spark.createDataFrame([("t", None), ("t", "x"), ("u", "x")], "a string, b string")
    assert [r["reused"] for r in M.cached_reuse(w, s, ["a", "b"], "k").orderBy("a", F.col("b").asc_nulls_first()).collect()] == ["3", "", "4"]
    names = spark.createDataFrame([("snowflake-arctic-embed2",), ("zzz",)], "name string")
    hints = spark.createDataFrame([("snowflake", 0), ("arctic-embed2", 1)], "hint string, ordinal int")
    assert {r["name"]: r["hint"] for r in M.first_hint(names, hints).collect()} == {"snowflake-arctic-embed2": "snowflake", "zzz": None}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 9)], "k string, v int")
    assert {r["k"]: r["v"] for r in M.layered([a, b], "k").collect()} == {"x": 1, "y": 9}
