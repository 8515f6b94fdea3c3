import json
import sqlite3
import time

import pytest

from leafmill import cli
from leafmill.sources import files as S
from leafmill.sources import sinks as K


def test_whole_documents_or_the_fallback(spark, monkeypatch):
    def slow(data):
        if data == b"hang":
            time.sleep(30)
        if data == b"bad":
            raise ValueError("unreadable")
        return data.decode()

    monkeypatch.setitem(S.PAGE_DECODERS, "slow", slow)
    pages = [("a", 1, b"one"), ("a", 2, b"two"), ("b", 1, b"one"), ("b", 2, b"hang"), ("c", 1, b"bad"), ("d", 1, b"x"), ("d", 3, b"y")]
    df = spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in pages], "document_path string, page int, content binary")
    files = spark.createDataFrame([(p, bytearray(f"{p}1\f{p}2".encode())) for p in "abcd"], "path string, content binary")
    got = {}
    for r in S.decode_documents(files, df, "slow", "plain", seconds=1.0).collect():
        got.setdefault((r["document_path"], r["mode"]), []).append((r["page"], r["text"], r["reason"]))
    assert sorted(got["a", "isolated_parallel_pages"]) == [(1, "one", ""), (2, "two", "")]
    again = {k[0]: sorted(v) for k, v in got.items() if k[1] == "sequential_after_parallel_fallback"}
    assert set(again) == {"b", "c", "d"} and [x[:2] for x in again["b"]] == [(1, "b1"), (2, "b2")]
    assert "timed out" in again["b"][0][2] and "unreadable" in again["c"][0][2] and "pages observed: 2, last 3" in again["d"][0][2]
    none = S.decode_documents(files, df, "slow", seconds=1.0).where("mode = 'failed'").collect()
    assert {r["document_path"] for r in none} == {"b", "c", "d"} and all(r["text"] is None for r in none)
    with pytest.raises(ValueError):
        S.decode_single_pages(df, "other")


def test_settings_and_catalogs(spark, tmp_path):
    db = tmp_path / "s.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE system_settings (label TEXT, value TEXT)")
        c.executemany("INSERT INTO system_settings VALUES (?, ?)", [("text_splitter_chunk_size", "768"), ("empty", None)])
    assert {tuple(r) for r in S.sqlite_settings(spark, str(db)).collect()} == {("text_splitter_chunk_size", "768"), ("empty", None)}
    assert S.sqlite_settings(spark, str(db), "other").count() == 0
    missing = S.missing_columns(S.sqlite_columns(spark, str(db)), {"system_settings": ["label", "kind"]})
    assert [tuple(r) for r in missing.collect()] == [("system_settings", "kind")]
    with pytest.raises(ValueError):
        S.sqlite_settings(spark, str(db), most=1)
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"id": "m/one-embed", "name": "M: One", "context_length": 8192, "top_provider": {"context_length": 512}}, {"canonical_slug": "m/two"}, {"name": "no id"}]}))
    got = {r["id"]: (r["context_length"], r["provider_context_length"]) for r in S.fetched_catalog(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"m/one-embed": (8192, 512), "m/two": (None, None)}
    assert S.fetched_catalog(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "bad.json").write_text("oops")
    assert S.fetched_catalog(spark, str(tmp_path / "bad.json")).count() == 0
    assert [r["id"] for r in S.embedding_models(S.fetched_catalog(spark, str(tmp_path / "c.json")), "id").collect()] == ["m/one-embed"]


def test_run_files(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, "a")], "run string, at int, state string")
    K.append_log(log, str(tmp_path / "log"))
    K.append_log(spark.createDataFrame([("r", 2, "b")], "run string, at int, state string"), str(tmp_path / "log"))
    assert [tuple(r) for r in K.latest(spark.read.json(str(tmp_path / "log")), "run", "at").select("run", "state").collect()] == [("r", "b")]
    run = tmp_path / "run"
    run.mkdir()
    (run / "run-result.json").write_text("{}")
    assert not K.compact_run(run, {}) and (run / "run-result.json").exists()
    (run / "run-summary.json").write_text(json.dumps({"a": 1, "recovery": {"x": 2, "state": "open"}}))
    assert K.compact_run(run, {"run_id": "r"}) and not (run / "run-result.json").exists()
    assert json.loads((run / "run-summary.json").read_text()) == {"a": 1, "recovery": {"x": 2, "state": "completed", "resume_required": False, "run_id": "r"}}
    K.report_files({"t": spark.createDataFrame([(2, "a|b"), (1, None)], "n int, s string")}, tmp_path / "rep", "Title")
    assert "| 2 | a\\|b |" in (tmp_path / "rep" / "report.md").read_text() and json.loads((tmp_path / "rep" / "report.json").read_text())["t"][0] == {"n": 1, "s": None}
    with pytest.raises(ValueError):
        K.report_files({"t": spark.range(5).toDF("n")}, tmp_path / "rep", "Title", most=4)


def test_log_keeps_secrets(tmp_path):
    log = K.run_log("leafmill.test", tmp_path / "l" / "run.jsonl", most_bytes=400, files=2)
    assert K.run_log("leafmill.test", tmp_path / "other.jsonl") is log
    log.info("api_key=abcdef at /home/someone/x and C:\\\\Users\\\\me", extra={"run_id": "r1"})
    said = json.loads((tmp_path / "l" / "run.jsonl").read_text())
    assert said["message"].startswith("api_key=[REDACTED] at [LOCAL_PATH] and ") and said["run_id"] == "r1" and "someone" not in said["message"]
    for _ in range(9):
        log.info("more and more")
    assert len(list((tmp_path / "l").iterdir())) == 3


def test_commands(spark, tmp_path):
    body = "word " * 200
    spark.createDataFrame([(1, 1, "page", body), (1, 2, "page", "Notes " + body)], "document_id long, page int, kind string, text string").write.parquet(str(tmp_path / "p"))
    cli.run(spark, ["segment", str(tmp_path / "p"), str(tmp_path / "o"), "--label", "A [b]", "--stop-after-page", "1", "--stop-heading", "Notes", "--validation-phrase", "WORD word", "--validation-phrase", "absent"])
    text = next(p for p in (tmp_path / "o" / "segments").rglob("*.txt") if p.is_file()).read_text()
    assert text.startswith("[A  b  | BACKEND  | PDF_PAGE 1 | SEGMENT 00001]\nword") or text.startswith("[A b  | BACKEND  | PDF_PAGE 1 | SEGMENT 00001]\nword")
    report = {r["pdf_page"]: r["status"] for r in spark.read.option("header", "true").csv(str(tmp_path / "o" / "report")).collect()}
    assert report == {"1": "included", "2": "stop_heading_detected"}
    found = {r["phrase"]: r["status"] for r in spark.read.option("header", "true").csv(str(tmp_path / "o" / "validation")).collect()}
    assert found == {"WORD word": "found", "absent": "missing"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("first page\fsecond page")
    cli.run(spark, ["extract", str(tmp_path / "docs"), str(tmp_path / "e"), "--decoder", "plain", "--pattern", "*.txt"])
    assert "[PDF_PAGE 2]\nsecond page" in next(p for p in (tmp_path / "e" / "extract").rglob("*.txt") if p.is_file()).read_text()
