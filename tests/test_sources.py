import json
import time

import pytest
from pyspark.sql import functions as F

from leafmill.sources import elements, files, sinks


def test_discovery_and_plain_decoder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF-1.4 one\fsecond page")
    (tmp_path / "y.pdf").write_bytes(b"not one")
    f = files.discover(spark, str(tmp_path))
    assert f.count() == 1 and len(files.hashed(f).first()["sha256"]) == 64
    p = files.decode_pages(f, "plain")
    assert [(r["page"], r["text"]) for r in p.orderBy("page").collect()] == [(1, "%PDF-1.4 one"), (2, "second page")]
    assert files.assert_coverage(p).count() == 0
    assert files.assert_coverage(p.where("page = 2")).count() == 1
    with pytest.raises(ValueError):
        files.decode_pages(f, "nothing")


def test_jsonl(spark, tmp_path):
    rows = [{"recorded_monotonic": 2.5, "phase": "metadata", "value": 0.5}, {"recorded_monotonic": -1}, {"recorded_monotonic": "3.5"}]
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, rows), "[1]", "{bad", "", "7"]))
    assert files.jsonl(spark, str(tmp_path)).count() == 3
    assert sorted(r["at"] for r in files.progress_events(spark, str(tmp_path)).collect()) == [2.5, 3.5]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/t.jsonl").write_text('{"elapsed_seconds": 3, "expected_seconds": 9}\n{"state": "x"}\n{"elapsed_seconds": -1}\n{"elapsed_seconds": "no"}')
    assert sorted(r["elapsed"] for r in files.progress_trace(spark, str(tmp_path / "t")).collect()) == [0.0, 3.0]


def test_timeline(spark):
    df = spark.createDataFrame([("1970-01-01T00:00:10Z",), ("1970-01-01T00:00:01Z",), ("no",), (None,)], "recorded_at string")
    assert [r["offset"] for r in files.timeline(df, F.lit(4.0)).collect()] == [6.0, 0.0, 0.0, 0.0]


def test_env(spark, tmp_path):
    (tmp_path / ".env").write_text("# A=0\nA='one'\nB=\"t\\u0077o\"\nA = three=3\nnoise\n")
    lines = files.env_lines(spark, str(tmp_path / ".env"))
    assert {r["key"]: r["value"] for r in files.env_values(lines).collect()} == {"A": "three=3", "B": "two"}
    assert {r["key"]: r["value"] for r in files.env_values(lines, first=True).collect()}["A"] == "one"


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\r\n\ny")
    assert [(r["line_no"], r["value"]) for r in files.text_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "x"), (2, ""), (3, "y")]


def test_manifest(spark):
    ok = spark.createDataFrame([(f"B0{i}", 3) for i in range(1, 9)], "document_id string, page_count int")
    assert files.manifest_problems(ok).count() == 0
    bad = spark.createDataFrame([("B01", 3), ("B01", 0), ("x", None)], "document_id string, page_count int")
    assert sorted(r[0] for r in files.manifest_problems(bad).collect()) == ["count", "duplicate_id", "id_format", "page_count"]


def test_model_show(spark):
    text = "  Model\n    architecture        bert\n    context length      512\n    embedding length    768\n\n  Capabilities\n    embedding\n    tools\n"
    r = spark.createDataFrame([(text,), ("",)], "t string").select(*[c.alias(n) for n, c in files.parse_model_show(F.col("t")).items()]).collect()
    assert tuple(r[0]) == ("bert", 512, 768, ["embedding", "tools"]) and r[1]["context_length"] is None


def test_page_cache(spark, tmp_path):
    ident = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, t string").select("s", files.cache_identity({"t": F.col("t"), "s": F.col("s")}).alias("identity"))
    ids = {r["s"]: r["identity"] for r in ident.collect()}
    pages = spark.createDataFrame([(ids["a"], 1, "p1"), (ids["a"], 2, "p2"), (ids["b"], 2, "gap")], "identity string, page int, text string")
    sinks.cache_pages(pages, str(tmp_path / "c"))
    hits, misses = files.cached_pages(ident, spark.read.parquet(str(tmp_path / "c")))
    assert hits.count() == 2 and [r["identity"] for r in misses.collect()] == [ids["b"]]


def test_elements_round(spark):
    pages = spark.createDataFrame([(1, 1, "# T\n\n- item\ntext"), (1, 2, None)], "document_id int, page int, text string")
    e = elements.line_elements(pages)
    assert [r["category"] for r in e.orderBy("element_index").collect()] == ["Title", "NarrativeText", "ListItem", "NarrativeText"]
    assert elements.elements_to_pages(e).first()["text"] == "[Title] # T\n\n[ListItem] - item\n\n[NarrativeText] text"


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "page", "b"), (1, 1, "page", "a"), (2, 1, "page", None)], "document_id int, page int, kind string, text string")
    sinks.extract_text(pages, str(tmp_path / "x"))
    assert (next((tmp_path / "x/document_id=1").glob("*.txt"))).read_text().rstrip("\n") == "\n\n[PDF_PAGE 1]\na\n\n[PDF_PAGE 2]\nb"
    sinks.page_report_csv(pages, str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 3
    assert not sinks.rows_csv(pages.limit(0), str(tmp_path / "n")) and sinks.rows_csv(pages, str(tmp_path / "m"))
    target = tmp_path / "s.json"
    for i in range(3):
        sinks.replace_json(target, {"i": i})
    assert json.loads(target.read_text()) == {"i": 2} and len(list(tmp_path.glob(".s*"))) == 0
    assert sinks.archive(target).name == "s-attempt-1.json" and sinks.archive(target) is None
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, t int, v string")
    assert sinks.latest(log, "k", "t").first()["v"] == "b"


def test_merge_settings(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("s", "new"), ("z", "9")], "key string, value string")
    snap = spark.createDataFrame([("a", True, "0", False), ("b", False, None, False), ("s", True, "", True)], "key string, present boolean, value string, secret boolean")
    assert {r["key"]: r["value"] for r in sinks.merge_settings(now, snap, ["a", "b", "s"]).collect()} == {"a": "0", "s": "new", "z": "9"}


def test_columns(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("seen_table")
    found = files.catalog_columns(spark)
    assert [tuple(r) for r in files.missing_columns(found, {"seen_table": ["id", "slug"]}).collect()] == [("seen_table", "slug")]
    spark.catalog.dropTempView("seen_table")
    assert time.monotonic() > 0
