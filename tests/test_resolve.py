from pyspark.sql import functions as F

from leafmill.operators import evidence as E
from leafmill.operators import report, resolve, timing


def test_runovers_are_judged_in_order(spark):
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    first, second = " ".join(words[:20]), " ".join(words[20:40])
    pages = spark.createDataFrame([(1, 1, "strip " + first), (1, 2, "own text " + second), (1, 3, "last page " + second), (1, 7, first), (2, 1, None)], "document_id long, page int, text string")
    # page 2's strip stands on page 1 only while page 1 keeps its own
    c = spark.createDataFrame([(1, 1, second, "page one without its strip"), (1, 2, first, "page two alone"), (1, 3, "few words only", "x"), (9, 1, first, "nowhere")], "document_id long, page int, narrow string, dominant string")
    got = {(r["document_id"], r["page"]): (r["text"], r["decision"], r["matched"]) for r in resolve.resolve_runovers(pages, c).collect()}
    assert got[1, 1] == ("page one without its strip", "confirmed_excluded", 20)
    assert got[1, 2] == ("own text " + second, "ambiguous_retained", 0)
    assert got[1, 3][1] == "ambiguous_retained" and got[1, 7] == (first, None, None) and got[2, 1] == ("", None, None) and len(got) == 5
    alone = resolve.resolve_runovers(pages, c.where("page = 2")).where("page = 2").first()
    assert alone["decision"] == "confirmed_excluded" and alone["text"] == "page two alone" and alone["ratio"] == 1.0


def test_prefix_rules():
    assert resolve.overlap("abcd efgh ijkl mnop qrst uvwx yzab cdef", " ".join(w + "xy" for w in "abcd efgh ijkl mnop qrst uvwx yzab cdef".split())) == (8, 8)
    assert resolve.overlap("abcd efgh ijkl mnop qrst uvwx yzab cdef", "abcdx") == (0, 8)
    assert resolve.overlap("one two", "anything") == (0, 2)
    long = [c * 7 for c in "abcdefgh"]
    assert resolve.overlap(" ".join(long), " ".join(w[:5] for w in long)) == (8, 8)


def test_values(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    limit = lambda a, b: v(resolve.runtime_limit(F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert (limit(5, 3), limit(0, 3), limit(5, None), limit(None, 0)) == (3, 3, 5, 4096)
    assert v(resolve.env_line(F.lit(" A_KEY "), F.lit('say "x"'))) == 'A_KEY="say \\"x\\""' and v(resolve.env_line(F.lit("A"), F.lit("two\nlines"))) is None and v(resolve.env_line(F.lit("A B"), F.lit("x"))) is None
    regions = lambda w, t: v(resolve.keep_both_regions(F.array(*map(F.lit, w)), F.array(*map(F.lit, t))))
    assert regions([0.58, 1.0], ["x" * 240] * 2) and not regions([0.57, 1.0], ["x" * 240] * 2) and not regions([1.0, 1.0], ["x" * 239, "x" * 240])
    assert v(F.array_join(resolve.unknown_fields(F.array(F.lit("b"), F.lit("z"), F.lit("a")), ["a"]), ",")) == "b,z"
    assert v(timing.substantive(F.lit(""), F.lit("desktop_queue"), F.lit(1), F.lit(2))) and not v(timing.substantive(F.lit("eta"), F.lit("desktop_queue"), F.lit(1), F.lit(2)))
    ok = resolve.layers_succeeded(F.lit("complete"), F.lit("pass"), F.lit(None).cast("string"))
    assert v(ok) is False and v(resolve.stage_outcome(F.lit("success"), F.lit(True), ok)) == "degraded" and v(resolve.stage_outcome(F.lit("success"), F.lit(None).cast("boolean"), ok)) == "success"


def test_aliases_and_first_rows(spark):
    catalog = spark.createDataFrame([("A b", "x"), ("c", "x")], "model string, provider string")
    given = spark.createDataFrame([("c", "A b", 0), ("c", "c", 1)], "alias string, model string, priority int")
    assert {tuple(r) for r in resolve.aliased(catalog, given).collect()} == {("a b", "A b"), ("c", "c")}
    df = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(5)], "g int, n int")
    assert resolve.first_of_each(df, ["g"], ["n"], 2).count() == 4 and resolve.first_of_each(df, ["g"], ["n"], 0).count() == 10
    got = {r["n"]: r["place"] for r in report.placed(df.where("g = 1"), ["n"]).collect()}
    assert got == {n: n + 1 for n in range(5)} and report.placed(df.where("g = 9"), ["n"]).count() == 0


def test_payloads(spark):
    doc = '{"a": [{"B_Path": 1, "ok": "C:\\\\x"}], "workspace_id": null, "v": "see secret-name", "h": "' + "a" * 64 + '", "k": "sk-abcdefgh1"}'
    df = spark.createDataFrame([(1, doc), (2, "{bad"), (3, '{"fine": [1, "x"]}'), (4, None)], "id int, body string")
    got = {r["id"]: r["violations"] for r in E.payload_violations(df, ["id"], "body", ("secret-name", "")).collect()}
    assert got == {1: ["API-key-like value", "absolute path", "forbidden key: B_Path", "forbidden key: workspace_id", "private source value", "sha256-like value"]}
