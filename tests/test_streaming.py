import json
import os

import pytest

from leafmill.streaming import progress as P


@pytest.fixture
def ends(spark):
    """Streams with time-outs end with their input."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _write(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n{bad\n")


def _run(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _event(run, seq, minute, **k):
    return {"run": run, "seq": seq, "recorded_at": f"2026-01-01T00:{minute:02d}:00Z", "phase": "p", "type": "t", "value": 0.1} | k


def test_windows_and_duplicates(spark, tmp_path):
    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0), _event("a", 1, 0), _event("a", 2, 1), _event("a", 3, 40)])
    e = P.event_stream(spark, str(src))
    w = _run(spark, P.phase_counts(P.unique_events(e), late=None), "append", "w", tmp_path)
    assert [r["n"] for r in w.orderBy("start").collect()][:2] == [1, 1]


def test_polls_end_once(spark, tmp_path, ends):
    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0, status="incomplete"), _event("a", 2, 1, status="pass"), _event("a", 3, 2, status="error"), _event("b", 1, 0, status="incomplete")])
    got = _run(spark, P.poll_stream(P.event_stream(spark, str(src)), "1 hour"), "append", "polls", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("a", 2, "pass")]


def test_deadline_counts_from_the_first_event(spark, tmp_path, ends):
    import time

    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0, status="incomplete")])
    polls = P.poll_stream(P.event_stream(spark, str(src), 1), "6 seconds")
    q = polls.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    began = time.monotonic()
    k = 1
    while time.monotonic() - began < 60 and not spark.table("late").count():
        k += 1
        _write(src, [_event("a", k, k % 60, status="incomplete")])  # keeps sending: this doesn't put the end off
        time.sleep(1)
    _write(src, [_event("a", 900, 59, status="pass")])  # too late
    q.processAllAvailable()
    q.stop()
    assert [r["verdict"] for r in spark.table("late").collect()] == ["timeout"]


def test_all_complete_counts_after_an_owned_event(spark, tmp_path, ends):
    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0, type="all_complete"), _event("a", 2, 0, location="d\\1", type="doc_complete"), _event("b", 1, 0, location="d/9", type="doc_complete"), _event("b", 2, 0, type="all_complete")])
    os.utime(src / "0.json", (1, 1))  # files are taken by their age
    _write(src, [_event("a", 3, 1, type="all_complete"), _event("a", 4, 1, location="d/9", type="doc_starting")])
    owned = spark.createDataFrame([("d/1",)], "location string")
    stream = P.routed_stream(spark, [str(tmp_path / "absent"), str(src)], files_per_trigger=1)
    q = P.emitted(P.owned_stream(stream, owned), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert P.until_cancelled(q, str(tmp_path / "stop")) == "completed"
    got = sorted((r["run"], r["seq"], r["type"]) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("a", 2, "doc_complete"), ("a", 3, "all_complete")]


def test_cancelled(spark, tmp_path):
    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0)])
    q = P.emitted(P.event_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    (tmp_path / "stop").touch()
    assert P.until_cancelled(q, str(tmp_path / "stop")) == "cancelled" and not q.isActive


def test_owned(spark, tmp_path, ends):
    src = tmp_path / "in"
    _write(src, [_event("a", 1, 0, location="d\\1", type="doc_complete"), _event("a", 2, 0, location="d/2", type="doc_complete")])
    owned = spark.createDataFrame([("d/1",)], "location string")
    e = P.owned_stream(P.event_stream(spark, str(src)), owned)
    got = _run(spark, P.completed_counts(e), "update", "owned", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("a", 1)]
